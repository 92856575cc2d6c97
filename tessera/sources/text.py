"""Text sources as Spark jobs: exposition-format scrapes, log chunks, worker tallies.

Parsing is column expressions: a scrape body is split and parsed inside its
own row with array functions (no per-body Python parser, no shuffle); log
chunks are exploded into pieces and reassembled by line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


NAME_RE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)"
LABELS_RE = r"^[a-zA-Z_:][a-zA-Z0-9_:]*\{(.*)\}"
VALUE_RE = r"^[a-zA-Z_:][a-zA-Z0-9_:]*(?:\{.*\})?\s+(\S+)(?:\s+[-+]?\d+)?\s*$"  # value, then perhaps a timestamp


def scrape_ingest(bodies: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Exposition text -> long samples ``(keys..., name, kind, le, value)``.

    ``vllm:`` becomes ``vllm_``; declared counter/gauge samples keep their
    kind; histogram ``_bucket`` lines become ``histogram`` rows (one per
    ``le``); summaries are dropped; untyped names ending in
    ``_sum``/``_count``/``_total`` are counters, other untyped ones gauges;
    labels are dropped and the last sample per name wins; of a histogram the
    buckets of one label set are kept, the one that its last line has.

    Each body is parsed inside its own row with array functions (the
    ``# TYPE`` declarations are looked up within the body, duplicates are
    resolved by sorting the body's samples), so the job is a map-only scan
    followed by one explode: no shuffle.
    """
    lines = F.split(F.replace(F.col(body), F.lit("vllm:"), F.lit("vllm_")), "\n")
    b = bodies.select(*keys, lines.alias("_l"))
    type_re = r"^#\s*TYPE\s+(\S+)\s+(\S+)"
    idx = F.sequence(F.lit(1), F.greatest(F.size("_l"), F.lit(1)))
    # declared types of this body as a map; a repeated declaration keeps its last kind
    decl = F.transform(F.filter(F.transform(idx, lambda i: F.struct(F.trim(F.try_element_at(F.col("_l"), i)).alias("t"), i.alias("i"))),
                                lambda x: x["t"].startswith("# TYPE ")),
                       lambda x: F.struct(F.regexp_extract(x["t"], type_re, 1).alias("n"), x["i"].alias("i"),
                                          F.lower(F.regexp_extract(x["t"], type_re, 2)).alias("k")))
    b = b.withColumn("_d", F.array_sort(decl))
    nd = F.size("_d")
    last_decl = F.filter(F.sequence(F.lit(1), F.greatest(nd, F.lit(1))), lambda i: (i <= nd) & (
        (i == nd) | (F.element_at("_d", i)["n"] != F.try_element_at("_d", i + 1)["n"])))
    b = b.withColumn("_types", F.map_from_entries(F.transform(last_decl, lambda i: F.struct(
        F.element_at("_d", i)["n"], F.element_at("_d", i)["k"]))))
    # stage 1: one regex pass per sample line
    s1 = F.transform(idx, lambda i: F.struct(i.alias("i"), F.trim(F.try_element_at(F.col("_l"), i)).alias("t")))
    s1 = F.filter(s1, lambda x: x["t"].isNotNull() & (F.length(x["t"]) > 0) & ~x["t"].startswith("#"))
    s1 = F.transform(s1, lambda x: F.struct(
        x["i"].alias("i"), F.regexp_extract(x["t"], NAME_RE, 1).alias("name"),
        F.regexp_extract(x["t"], LABELS_RE, 1).alias("labels"), F.regexp_extract(x["t"], VALUE_RE, 1).alias("rv")))
    b = b.withColumn("_s", s1)

    # stage 2: classification from the already extracted fields
    def parse(x):
        name, rv = x["name"], x["rv"]
        value = F.when(rv == "+Inf", F.lit(float("inf"))).when(rv == "-Inf", F.lit(float("-inf"))).otherwise(rv.try_cast("double"))
        hb = F.when(name.endswith("_bucket"), name.substr(F.lit(1), F.length(name) - F.lit(7)))
        le_txt = F.regexp_extract(x["labels"], r'(?:^|,)\s*le="([^"]*)"', 1)
        le = F.when(le_txt == "+Inf", F.lit(float("inf"))).otherwise(le_txt.try_cast("double"))
        is_hist = F.coalesce((F.try_element_at("_types", hb) == "histogram") & (le_txt != ""), F.lit(False))
        d = F.try_element_at("_types", name)
        kind = (F.when(is_hist, "histogram").when(d == "counter", "counter").when(d == "gauge", "gauge")
                .when(d == "summary", F.lit(None).cast("string"))
                .when(name.rlike("(_sum|_count|_total)$"), "counter").otherwise("gauge"))
        others = F.regexp_replace(F.concat(F.lit(","), x["labels"]), r',\s*le="[^"]*"', "")
        return F.struct(F.when(is_hist, hb).otherwise(name).alias("name"), kind.alias("kind"), F.when(is_hist, le).alias("le"),
                        x["i"].alias("i"), value.alias("value"), F.when(is_hist, others).alias("others"))

    b = b.withColumn("_p", F.filter(F.transform("_s", parse),
                                    lambda p: p["value"].isNotNull() & (p["name"] != "") & p["kind"].isNotNull()))
    # one label set per histogram: that of its last line, by the greatest (line, labels) of each name
    hist = F.array_sort(F.transform(F.filter("_p", lambda p: p["others"].isNotNull()), lambda p: F.struct(p["name"].alias("n"), p["i"].alias("i"), p["others"].alias("o"))))
    b = b.withColumn("_h", hist)
    nh = F.size("_h")
    last_hist = F.filter(F.sequence(F.lit(1), F.greatest(nh, F.lit(1))), lambda i: (i <= nh) & (
        (i == nh) | (F.element_at("_h", i)["n"] != F.try_element_at("_h", i + 1)["n"])))
    b = b.withColumn("_sets", F.map_from_entries(F.transform(last_hist, lambda i: F.struct(F.element_at("_h", i)["n"], F.element_at("_h", i)["o"]))))
    b = b.withColumn("_p", F.filter("_p", lambda p: p["others"].isNull() | (p["others"] == F.try_element_at("_sets", p["name"]))))
    # last sample per (name, le) wins: sort by (name, kind, le, line) and keep the last of each run
    b = b.withColumn("_p", F.array_sort("_p"))
    n = F.size("_p")
    keep = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (
        (i == n) | (F.element_at("_p", i)["name"] != F.try_element_at("_p", i + 1)["name"])
        | ~F.element_at("_p", i)["le"].eqNullSafe(F.try_element_at("_p", i + 1)["le"])))
    b = b.select(*keys, F.explode(F.transform(keep, lambda i: F.element_at("_p", i))).alias("_x"))
    return b.select(*keys, "_x.name", "_x.kind", "_x.le", "_x.value")


def log_filter(lines: DataFrame, keyword: str, exclude: bool = False, col: str = "line") -> DataFrame:
    """Case-insensitive substring include (or exclude); a blank keyword keeps every line."""
    k = keyword.strip().lower()
    if not k:
        return lines
    hit = F.lower(F.col(col)).contains(F.lit(k))
    return lines.where(~hit if exclude else hit)


def log_severity(line):
    l = F.lower(line)
    return F.when(l.contains("error") | l.contains("traceback"), "error").when(l.contains("warn"), "warning").otherwise("info")


def load_tally(lines: DataFrame, col: str = "line") -> DataFrame:
    """Sum of ``requests=``, ``failures=`` and ``completion_tokens=`` over worker log lines."""
    def num(k):
        v = F.regexp_extract(col, k + r"=(\d+)", 1)
        return F.when(v != "", v.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return lines.agg(F.sum(num("requests")).alias("requests"), F.sum(num("failures")).alias("failures"),
                     F.sum(num("completion_tokens")).alias("completion_tokens"))
