"""Quality rules: outliers by minimum-covariance-determinant estimates (DataFrame operations only).

Every document gets whole-text statistics. Documents that fail the base rule go. The others are described by
a vector of transformed statistics (logarithms of mean word length, symbols, repeated lines and repeated
words), and each language and source gets a robust centre and covariance of its vectors: concentration
steps from two starts (Rousseeuw and Van Driessen's C-steps) look for the three quarters of the documents
whose covariance has the smallest determinant. The better start is reweighted once, and documents whose
squared Mahalanobis distance exceeds ``cutoff`` are rejected.

A step is one aggregation: distances fall into bins on a logarithmic scale, each bin keeps the count, sums
and products of its vectors, and the bins up to the wanted share of the documents give the next estimate. Vectors
are whole thousandths and sums are exact, so reruns agree.

In clean text most statistics are constant, so a group's covariance may be degenerate. The search has floors for
that. In the result a variance that is smaller than the spread pooled over all groups (from the 99th percentile of
the distances from the own centre, of documents that count in the reweighting) is raised to it; ``units`` are the
least deviations, so that alone one symbol, repeated line or repeated phrase in the shortest document judged
is no outlier.

Text with tables is judged by other text with tables: documents whose symbols are mostly cell marks (bars that
stand alone) are groups of their own, if at least ``marked`` of their source's documents are such. Elsewhere,
and where these groups are too small for an estimate, they are judged with the other documents.

Groups with fewer than ``least`` documents are pooled by language, and these, if still small, together; a
pool that is too small has no estimate and rejects nothing.

Defined results: a null text has no words and fails the base rule; null language and null source are values
of their own; repeated rows count and are judged each; an empty table gives an empty result; extra columns
are not read. Three-word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, WS, written

DIMS = 4


@dataclass(frozen=True)
class Settings:
    """half: share of the documents that an estimate rests on. factor: makes its covariance consistent for normal
    vectors. inner: squared distance up to which documents count in the reweighting. floors: standard deviations
    added in the search for these documents. units: least standard deviations of the result. marked: least share
    of documents with tables in a source that has them. cutoff: squared distance beyond which a document goes (1 in
    2 million normal vectors)."""

    least: int = 50
    steps: int = 8
    half: float = 0.75
    factor: float = 1.49
    inner: float = 11.14
    floors: tuple[float, ...] = (0.1, 0.5, 0.5, 0.5)
    units: tuple[float, ...] = (0.05, 0.2, 0.2, 0.45)
    marked: float = 0.01
    cutoff: float = 36.0


def _bound(value: Column, f) -> Column:
    """``f`` of a variable that holds ``value``, so that it is computed once."""
    return F.transform(F.array(value), f)[0]


def _repeated(words: Column) -> Column:
    """Number of words in three-word windows that are found twice or more."""

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def again(s: Column) -> Column:
        # In hash order equal windows are neighbours.
        return F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])))

    def covered(p: Column) -> Column:
        first = F.transform(p, lambda x: x["i"])
        return F.size(F.array_union(F.array_union(first, F.transform(p, lambda x: x["i"] + 1)), F.transform(p, lambda x: x["i"] + 2)))

    return _bound(words, lambda w: F.when(F.size(w) < 3, 0).otherwise(_bound(F.sort_array(windows(w)), lambda s: _bound(again(s), covered))))


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without the text, with n_words, word_chars, n_symbols, n_cells, n_dup_lines and n_repeat_words (long)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    counts = {
        "n_words": F.regexp_count(text, F.lit(WORD)),
        "word_chars": F.length(F.regexp_replace(text, f"[{WS}]+", "")),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")),
        "n_cells": F.size(F.filter(words, lambda x: x == "|")),
        "n_dup_lines": _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeated(words),
    }
    return df.withColumns({k: v.cast("long") for k, v in counts.items()}).drop(text_col)


def _vector() -> list[Column]:
    """The transformed statistics, in thousandths."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    x = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
         F.log1p(100 * F.col("n_dup_lines") / words), F.log1p(100 * F.col("n_repeat_words") / words)]
    return [F.round(1000 * c).cast("long").alias(f"x{i}") for i, c in enumerate(x)]


def _chained(groups: DataFrame, kind: str, s: Settings) -> DataFrame:
    """(lang, source, pool) of groups (lang, source, n): their own pool, the language's, one for all, or null."""
    own = F.to_json(F.struct(F.lit(kind).alias("kind"), "lang", "source"))
    tongue = F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(2).alias("level"), "lang"))
    groups = groups.withColumn("pool", F.when(F.col("n") >= s.least, own).otherwise(tongue))
    for wider in (F.lit(f"all {kind}"), F.lit(None).cast("string")):
        many = groups.groupBy(F.col("pool").alias("_pool")).agg(F.sum("n").alias("_n"))
        groups = groups.join(many, F.col("pool") == F.col("_pool")).withColumn("pool", F.when(F.col("_n") >= s.least, F.col("pool")).otherwise(wider)).drop("_pool", "_n")
    return groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "pool", "n")


def _pooled(rows: DataFrame, s: Settings) -> DataFrame:
    """Column ``pool``: the group whose estimate judges a document (null: none)."""
    rows = rows.withColumn("cells", (F.col("n_cells") > 0) & (2 * F.col("n_cells") >= F.col("n_symbols")))
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    groups = rows.groupBy("lang", "source", "cells").agg(F.count_if(~F.col("base_failed")).alias("n"))
    whole = Window.partitionBy("source")
    share = F.sum(F.when(F.col("cells"), F.col("n")).otherwise(0)).over(whole) / F.sum("n").over(whole)
    groups = written(groups.withColumn("tables", F.col("cells") & F.coalesce(share >= s.marked, F.lit(False))), "groups")
    tables = _chained(groups.where("tables").select("lang", "source", "n"), "tables", s).withColumn("_tables", F.lit(True))
    # Few tables beside a language's large groups of them are judged with the largest.
    largest = F.max_by("pool", F.when(F.col("pool").isNotNull(), F.struct("n", "pool"))).over(Window.partitionBy("_lang"))
    tables = tables.withColumn("pool", F.coalesce("pool", largest)).drop("n")
    groups = groups.join(tables, on & (F.col("tables") == F.col("_tables")), "left").drop("_lang", "_source", "_tables")
    groups = written(groups.withColumnRenamed("pool", "table_pool"), "groups")
    others = _chained(groups.where("table_pool is null").groupBy("lang", "source").agg(F.sum("n").alias("n")), "text", s).drop("n")
    groups = groups.join(others, on, "left").select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("cells").alias("_cells"), F.coalesce("table_pool", "pool").alias("pool"))
    groups = written(groups, "pools")
    return rows.join(groups, on & (F.col("cells") == F.col("_cells"))).drop("_lang", "_source", "_cells", "cells")


def _sums() -> list[Column]:
    """Count, sums and products of the vectors."""
    out = [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)]
    return out + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(DIMS) for j in range(i + 1)]


def _summed() -> list[Column]:
    names = ["n"] + [f"s{i}" for i in range(DIMS)] + [f"q{i}{j}" for i in range(DIMS) for j in range(i + 1)]
    return [F.sum(c).alias(c) for c in names]


def _estimate(sums: DataFrame, keys: list[str], factor: float, variance) -> DataFrame:
    """keys, centre m*, the Cholesky factor l** of the covariance and its log-determinant. ``variance``: of i and
    the variance of the sums, the one to use."""
    df = sums.select("*", *[(F.col(f"s{i}") / F.col("n") / 1000.0).alias(f"m{i}") for i in range(DIMS)],
                     *[(F.col(f"q{i}{j}") / F.col("n") / 1e6).alias(f"e{i}{j}") for i in range(DIMS) for j in range(i + 1)])

    def cov(i: int, j: int) -> Column:
        found = (F.col(f"e{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor
        return variance(i, found) if i == j else found

    return _factored(df, keys, cov)


def _factored(df: DataFrame, keys: list[str], cov) -> DataFrame:
    for i in range(DIMS):
        for j in range(i + 1):
            rest = cov(i, j)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # The least variances keep the pivots positive; the bound is for rounding.
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(1, DIMS)), 2 * F.log("l00"))
    return df.select(*keys, *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)], logdet.alias("logdet"))


def _distance(df: DataFrame) -> DataFrame:
    """Column ``d2``: the squared Mahalanobis distance, by forward substitution."""
    for i in range(DIMS):
        y = F.col(f"x{i}") / 1000.0 - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        df = df.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, DIMS)), F.col("y0") * F.col("y0")))


def estimates(rows: DataFrame, s: Settings) -> DataFrame:
    """(pool, centre, factor, logdet) of the pools, by MCD and one reweighting."""
    rows = rows.where("not base_failed and pool is not null").select("pool", *[f"x{i}" for i in range(DIMS)])
    # Whole thousandths have few distinct values, so the exact percentile keeps few counts.
    middle = rows.groupBy("pool").agg(*[F.percentile(f"x{i}", 0.5).alias(f"c{i}") for i in range(DIMS)])
    gaps = rows.join(middle, "pool").groupBy("pool").agg(*[F.first(f"c{i}").alias(f"c{i}") for i in range(DIMS)], *[
        F.percentile(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 0.5).alias(f"g{i}") for i in range(DIMS)])
    start = gaps.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "pool", "start", *[(F.col(f"c{i}") / 1000.0).alias(f"m{i}") for i in range(DIMS)],
        *[F.when(F.col("start") == 0, F.pow(1.4826 * F.col(f"g{i}") / 1000.0, 2)).otherwise(0.0).alias(f"v{i}") for i in range(DIMS)])
    keys = ["pool", "start"]
    params = written(_factored(start, keys, lambda i, j: F.col(f"v{i}") + s.floors[i] ** 2 if i == j else F.lit(0.0)), "mcd")
    full = Window.partitionBy(*keys)
    upto = full.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(s.steps):
        far = _distance(rows.join(params, "pool")).withColumn("bin", F.floor(16 * F.log1p("d2")))
        bins = far.groupBy(*keys, "bin").agg(*_sums())
        bins = bins.withColumn("all", F.sum("n").over(full)).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        near = bins.where(F.col("before") < F.ceil(s.half * F.col("all"))).groupBy(*keys).agg(*_summed())
        params = written(_estimate(near, keys, s.factor, lambda i, v: v + s.floors[i] ** 2), "mcd")
    best = params.groupBy("pool").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    params = params.join(best, keys).drop("start")
    inner = _distance(rows.join(params, "pool")).where(F.col("d2") <= s.inner).select("pool", *[f"x{i}" for i in range(DIMS)])
    inner = written(inner, "inner")
    sums = written(inner.groupBy("pool").agg(*_sums()), "sums")
    centres = sums.select("pool", *[F.round(F.col(f"s{i}") / F.col("n")).cast("long").alias(f"c{i}") for i in range(DIMS)])
    # The 99th percentile of normal distances is 2.576 deviations.
    spread = inner.join(centres, "pool").agg(*[(F.percentile(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 0.99) / 2576.0).alias(f"p{i}") for i in range(DIMS)])
    least = lambda i, v: F.greatest(v, F.pow(F.col(f"p{i}"), 2), F.lit(s.units[i] ** 2))
    return written(_estimate(sums.crossJoin(F.broadcast(spread)), ["pool"], 1.0, least), "mcd")


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", s: Settings = Settings()) -> DataFrame:
    """One row per document: id, the statistics, base_failed, distance2 (null where not judged) and kept."""
    named = {"id": id_col, "text": text_col, "lang": lang_col, "source": source_col}
    rows = statistics(df.select(*[F.col(f"`{c}`").alias(n) for n, c in named.items()]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(rows.withColumn("base_failed", failed).select("*", *_vector()), "statistics")
    rows = written(_pooled(rows, s), "pooled")
    out = _distance(rows.join(estimates(rows, s), "pool", "left"))
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= s.cutoff))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", d2.alias("distance2"), kept.alias("kept"))
