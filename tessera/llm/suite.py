"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

from . import bpe, chat, exact_dedup, fim, mixing, near_dedup, periodic, prefix_hash, quality, rans, toxicity, url_filter, warc
from .common import scratch, small_batches, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            small_batches(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_block_mixing")
def block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixing.taken(m).withColumnRenamed("id", "doc_id")


@query("op6_heavy_hitter_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER w = 1 AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)
""")
def heavy_hitter_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op7_setsketch_near_dedup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (
  SELECT a, b FROM p
  UNION
  SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id,
       s.doc_id <= coalesce(low, s.doc_id) AS kept
FROM s LEFT JOIN m USING (doc_id)
""")
def setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@query("op8_prefix_dp_bpe")
def prefix_dp_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE).drop("text"), BYTE_BPE)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_toxicity_chain")
def toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.col("p_junk"), F.col("p_toxic"), F.col("is_toxic").alias("toxic"), (~F.col("is_toxic")).alias("kept"))


@query("op2_mcd_quality")
def mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def _url_sql() -> str:
    """Brute force: every rule against every URL."""
    values = ", ".join(f"({i}, '{r.verdict}', '{r.pattern}', {repr(r.text) if r.text else 'NULL'})" for i, r in enumerate(url_filter.HOST_RULES + url_filter.WORD_RULES))
    return rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(number, verdict, pattern, rule) AS (VALUES {values}),
m AS (SELECT p.page_id, r.* FROM p JOIN r ON regexp_matches(p.host || p.path, r.pattern)),
b AS (SELECT page_id, arg_max(rule, length(rule)) FILTER (rule IS NOT NULL) AS rule, arg_max(verdict, length(rule)) FILTER (rule IS NOT NULL) AS own,
             bool_or(rule IS NULL AND verdict = 'block') AS blocked FROM m GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b USING (page_id)
"""


@query("op4_rarest_token_url_filter", _url_sql())
def rarest_token_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"))


@query("op3_rans_token_files")
def rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "rans")
    shards = rans.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, WORD_BPE)
    return rans.read(shards, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


@query("op10_warc_source", r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''),
    lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits
  FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT)
      + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT), 1)), '') AS payload_digest
  FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
""")
def warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    # Payloads are inflated to verify them, and stay in the reader.
    records = warc.load(spark, folder, payload="false").where(F.col("record_type").isin("response", "revisit"))
    return records.select(F.col("page_id").cast("long").alias("page_id"), F.col("payload_length").cast("long").alias("payload_bytes"),
                          F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op1_perspective_rotation", r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS pos
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (
  SELECT conv_id, perspective, pos, speaker = perspective AS own, text,
         CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head
  FROM t JOIN p USING (conv_id)),
o AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, perspective ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s)
SELECT conv_id, perspective, CAST(0 AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n_turns, string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered,
       string_agg(CAST(before + length(head) AS BIGINT) || '-' || CAST(before + length(head) + length(text) + 7 AS BIGINT), ',' ORDER BY pos) FILTER (own) AS mask
FROM o GROUP BY conv_id, perspective
""")
def perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.whole(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return out.select("conv_id", "perspective", "part", "n_turns", "rendered", mask.alias("mask"))


@query("op11_prefix_polynomial_fingerprint")
def prefix_polynomial_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.neighbour_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op12_seekable_frame_fim", r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents),
h AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4
  FROM u),
c AS (
  SELECT doc_id, text, CAST(n AS BIGINT) AS n, units, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle, array_to_string(units[hi + 1:n], '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""")
def seekable_frame_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(fim.store(table(spark, sf_dir, "documents")), "frames")
    done = fim.transformed(stored)
    return done.select(F.col("id").cast("long").alias("doc_id"), *[c for c in done.columns if c != "id"])


def replanted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one text in ten, by the id's checksum, repeats a stretch of its words to its end. Null ids don't."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("words"), F.expr("h div 10")
    placed = chosen.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", F.expr("cast(1 + (size(words) - a) div (3 + (h div 10) % 8) as int)"))
    again = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(1 + (size(words) - a) div p as int))), 1, size(words) - a))")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_maximal_pair_runs", r"""
WITH h AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w0,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents),
g AS (
  SELECT doc_id, w0, CAST(len(w0) AS BIGINT) AS n, coalesce(h % 10 = 0, false) AND len(w0) > 0 AS planted, (h // 10) % len(w0) AS a, h // 10 AS g FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w0 END AS ws FROM p),
e AS (
  SELECT doc_id, n, unnest(range(n - 4)) AS i, unnest(list_transform(range(n - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' '))) AS x FROM w WHERE n >= 6),
q AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q),
r AS (SELECT doc_id, min(i) AS start, count(*) + 4 + q AS length, q FROM s GROUP BY doc_id, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
k AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
         max({'length': length, 'start': -start, 'period': -period}) AS best FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed
  FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(ws) AS word FROM w) t
  WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.doc_id = t.doc_id AND t.i >= runs.start + runs.period AND t.i < runs.start + runs.length)
  GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, -best.start AS start, best.length AS length, -best.period AS period, (1000 * best.length) // -best.period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def maximal_pair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(replanted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"))
    return rows.select(F.col("id").alias("doc_id"), "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                       F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
