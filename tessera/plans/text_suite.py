"""Registered queries: scrape ingest (checked by round trip), log reassembly, filters, tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import histograms as HG
from ..sources import fixtures as fx
from ..sources import logs as LG
from ..sources import tables
from ..sources import text as TX
from .registry import query

K = ["engine_key", "tick_ts"]
# Exposition names of the histograms.
HIST_NAMES = {"ttft": "vllm:time_to_first_token_seconds", "itl": "vllm:inter_token_latency_seconds",
              "e2e": "vllm:e2e_request_latency_seconds", "tpot": "vllm:request_time_per_output_token_seconds"}
_HIST_SQL = "CASE metric " + " ".join(f"WHEN '{k}' THEN '{v.replace(':', '_')}'" for k, v in HIST_NAMES.items()) + " END"


def scrape_bodies(spark, sf):
    """Exposition bodies per (engine, hour) assembled from the snapshot and histogram views."""
    s = fx.engine_snapshots(spark, sf).select(*K, "model_name", "active_requests", "total_prompt_tokens", "n_events")
    hk = [*K, "metric"]
    hist = HG.collect_buckets(fx.view(spark, sf, "hist_buckets"), hk).join(fx.view(spark, sf, "hist_totals"), hk)
    hist = hist.join(s.select(*K, F.coalesce("model_name", F.lit("none")).alias("model")), K)
    name = F.element_at(F.create_map(*[F.lit(x) for kv in HIST_NAMES.items() for x in kv]), F.col("metric"))
    own = F.concat(F.lit('model_name="'), F.col("model"), F.lit('"'))
    le_txt = lambda x: F.when(x["le"] == F.lit(float("inf")), F.lit("+Inf")).otherwise(x["le"].cast("string"))
    hist = hist.select(*K, F.concat(
        F.array(F.concat(F.lit("# TYPE "), name, F.lit(" histogram"))),
        F.transform("buckets", lambda x: F.concat(name, F.lit('_bucket{le="'), le_txt(x), F.lit('",'), own, F.lit("} "), x["cum"].cast("bigint").cast("string"))),
        F.array(F.concat(name, F.lit("_sum{"), own, F.lit("} "), F.col("sum_s").cast("string")),
                F.concat(name, F.lit("_count{"), own, F.lit("} "), F.col("count").cast("bigint").cast("string")))).alias("h"))
    hist = hist.groupBy(*K).agg(F.flatten(F.collect_list("h")).alias("hists"))  # four histograms at most
    d = s.join(hist, K, "left")
    lab = F.concat(F.lit('model_name="'), F.coalesce("model_name", F.lit("none")), F.lit('"'))
    lines = F.concat(
        F.array(F.lit("# HELP vllm:num_requests_running Number of requests running."),
                F.lit("# TYPE vllm:num_requests_running gauge"),
                F.concat(F.lit("vllm:num_requests_running{"), lab, F.lit("} "), F.col("active_requests").cast("string")),
                F.lit("# TYPE vllm:prompt_tokens_total counter"),
                F.concat(F.lit("vllm:prompt_tokens_total{"), lab, F.lit("} "), F.col("total_prompt_tokens").cast("string"), F.lit(" 1700000000000"))),
        F.coalesce("hists", F.array().cast("array<string>")),
        F.array(F.concat(F.lit("process_cpu_seconds_total "), F.col("n_events").cast("string")),
                F.lit('python_info{version="3.12"} 1'),
                F.lit("# TYPE rpc_latency summary"), F.lit('rpc_latency{quantile="0.5"} 1.5'),
                F.lit("rpc_latency_sum 3"), F.lit("rpc_latency_count 2")),
    )
    return d.select(*K, F.array_join(lines, "\n").alias("body"))


_SCRAPE_SQL = fx.duck_cte("engine_snapshots", "hist_buckets", "hist_totals") + f"""
SELECT engine_key, tick_ts, 'vllm_num_requests_running' AS name, 'gauge' AS kind, NULL::DOUBLE AS le, CAST(active_requests AS DOUBLE) AS value FROM engine_snapshots
UNION ALL SELECT engine_key, tick_ts, 'vllm_prompt_tokens_total', 'counter', NULL, CAST(total_prompt_tokens AS DOUBLE) FROM engine_snapshots
UNION ALL SELECT engine_key, tick_ts, 'process_cpu_seconds_total', 'counter', NULL, CAST(n_events AS DOUBLE) FROM engine_snapshots
UNION ALL SELECT engine_key, tick_ts, 'python_info', 'gauge', NULL, 1.0 FROM engine_snapshots
UNION ALL SELECT engine_key, tick_ts, 'rpc_latency_sum', 'counter', NULL, 3.0 FROM engine_snapshots
UNION ALL SELECT engine_key, tick_ts, 'rpc_latency_count', 'counter', NULL, 2.0 FROM engine_snapshots
UNION ALL SELECT h.engine_key, h.tick_ts, {_HIST_SQL}, 'histogram', le, CAST(CAST(cum AS BIGINT) AS DOUBLE)
  FROM hist_buckets h JOIN engine_snapshots s USING (engine_key, tick_ts)
UNION ALL SELECT h.engine_key, h.tick_ts, {_HIST_SQL} || '_sum', 'counter', NULL, sum_s
  FROM hist_totals h JOIN engine_snapshots s USING (engine_key, tick_ts)
UNION ALL SELECT h.engine_key, h.tick_ts, {_HIST_SQL} || '_count', 'counter', NULL, CAST(CAST(count AS BIGINT) AS DOUBLE)
  FROM hist_totals h JOIN engine_snapshots s USING (engine_key, tick_ts)
"""


@query("scrape_ingest", _SCRAPE_SQL)
def q_scrape_ingest(spark, sf):
    return TX.scrape_ingest(scrape_bodies(spark, sf), K)


# ---------------------------------------------------------------- logs

CHUNK = 200


def _chunks_sql(d) -> str:
    # Braces are doubled for spark.sql(). Spark cuts a text in one pass: substring() counts from the text's beginning for each chunk.
    gen = ("CROSS JOIN LATERAL (SELECT unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS i) g" if d.name == "duckdb"
           else f"LATERAL VIEW posexplode(regexp_extract_all(text, '(?s).{{{{1,{CHUNK}}}}}', 0)) g AS i, cut")
    chunk = f"substring(text, CAST(i * {CHUNK} + 1 AS INT), {CHUNK})" if d.name == "duckdb" else "cut"
    s = f"""SELECT 'ctr-' || CAST(doc_id % 5 AS STRING) AS container,
  CASE WHEN doc_id % 3 = 0 THEN 'stderr' ELSE 'stdout' END AS stream,
  doc_id * 1000000000 + i AS seq, {chunk} AS chunk
FROM {d.t('documents')} {gen} WHERE length(text) > 0"""
    return s.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


_LINES_SQL = f"""
WITH c AS ({_chunks_sql(fx.DUCK)}),
s AS (SELECT container, stream, string_agg(chunk, '' ORDER BY seq) AS t FROM c GROUP BY 1, 2),
l AS (SELECT container, stream, u.line, u.n - 1 AS line_no, len(string_split(t, chr(10))) AS total
      FROM s, LATERAL (SELECT unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n) u),
k AS (SELECT * FROM l WHERE line_no < total - 1 OR line <> '')
SELECT container, stream, line_no, CASE WHEN stream = 'stderr' THEN '[stderr] ' || line ELSE line END AS line FROM k
"""


def lines(spark, sf):
    docs = tables.read(spark, sf, "documents", "doc_id", "text")
    return LG.log_lines(spark.sql(_chunks_sql(fx.SPARK), documents=docs)).select("container", "stream", "line_no", "line")


def _frames_sql(d) -> str:
    """The chunks as frames of both streams and of the console. Two containers end, one fails before its last text, two are open."""
    s = f"""
SELECT container, CASE WHEN {d.div('seq', '1000000000')} % 29 = 7 THEN 'console' ELSE stream END AS kind, seq, chunk FROM ({_chunks_sql(d)}) x
UNION ALL
SELECT container, CASE WHEN container = 'ctr-1' THEN 'error' ELSE 'end' END, CASE WHEN container = 'ctr-1' THEN last * 1000000000 - 1 ELSE last * 1000000000 + 999999999 END, 'code 137'
FROM (SELECT 'ctr-' || CAST(doc_id % 5 AS STRING) AS container, max(doc_id) AS last FROM {d.t('documents')} GROUP BY 1) m
WHERE container IN ('ctr-0', 'ctr-1', 'ctr-3')"""
    return s.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


_EVENTS_SQL = f"""
WITH c AS ({_frames_sql(fx.DUCK)}),
st AS (SELECT container, arg_min(kind, seq) AS stopped, min(seq) AS stop, arg_min(chunk, seq) AS said FROM c WHERE kind IN ('error', 'end') GROUP BY 1),
v AS (SELECT c.*, stopped, stop FROM c LEFT JOIN st USING (container) WHERE stop IS NULL OR seq < stop),
n AS (SELECT *, length(chunk) - length(replace(chunk, chr(10), '')) AS nl FROM v),
f AS (SELECT *, CAST(sum(nl) OVER (PARTITION BY container, kind ORDER BY seq) - nl AS BIGINT) AS before FROM n),
s AS (SELECT container, kind, any_value(stopped) AS stopped, any_value(stop) AS stop, string_agg(chunk, '' ORDER BY seq) AS t FROM v WHERE kind IN ('stdout', 'stderr') GROUP BY 1, 2),
l AS (SELECT container, kind, stopped, stop, u.line, u.n - 1 AS line_no, len(string_split(t, chr(10))) AS total
      FROM s, LATERAL (SELECT unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n) u),
o AS (
  SELECT l.container, l.kind, f.seq, CAST(l.line_no - f.before AS BIGINT) AS pos, line FROM l JOIN f
    ON l.container = f.container AND l.kind = f.kind AND l.line_no >= f.before AND l.line_no < f.before + f.nl
  UNION ALL SELECT container, kind, stop, CASE kind WHEN 'stderr' THEN 1 ELSE 0 END, line FROM l WHERE line_no = total - 1 AND line <> '' AND stopped = 'end')
SELECT container, kind, seq, pos, CAST(0 AS BIGINT) AS part, CASE kind WHEN 'stderr' THEN '[stderr] ' || line ELSE line END AS line FROM o
UNION ALL SELECT container, kind, seq, 0, 0, chunk FROM v WHERE kind = 'console'
UNION ALL SELECT container, stopped, stop, 2, 0, CASE stopped WHEN 'end' THEN 'LOG:Stream ended - container stopped' ELSE 'ERR:Log stream error: ' || said END FROM st
"""


@query("log_lines", _EVENTS_SQL)
def q_log_lines(spark, sf):
    docs = tables.read(spark, sf, "documents", "doc_id", "text")
    return LG.log_events(spark.sql(_frames_sql(fx.SPARK), documents=docs))


@query("log_filter", f"SELECT * FROM ({_LINES_SQL}) x WHERE contains(lower(line), 'le') AND NOT contains(lower(line), 'stderr')")
def q_log_filter(spark, sf):
    l = TX.log_filter(lines(spark, sf), "LE")
    return TX.log_filter(TX.log_filter(l, "  "), "stderr", exclude=True)


@query("log_severity", f"""SELECT container, stream, line_no,
  CASE WHEN contains(lower(line), 'error') OR contains(lower(line), 'traceback') THEN 'error'
       WHEN contains(lower(line), 'warn') THEN 'warning' ELSE 'info' END AS severity
FROM ({_LINES_SQL}) x""")
def q_log_severity(spark, sf):
    return lines(spark, sf).select("container", "stream", "line_no", TX.log_severity(F.col("line")).alias("severity"))


def _worker_sql(d) -> str:
    s = (f"SELECT 'worker-' || CAST(conv_id % 16 AS STRING) || ' ok requests=' || CAST(turn + 1 AS STRING) || ' failures=' || "
         f"CAST(turn % 2 AS STRING) || CASE WHEN role = 'user' THEN ' completion_tokens=' || CAST(length(text) AS STRING) ELSE '' END AS line "
         f"FROM {d.t('conversations')}")
    return s.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


@query("load_tally", f"""SELECT
  CAST(sum(COALESCE(TRY_CAST(NULLIF(regexp_extract(line, 'requests=(\\d+)', 1), '') AS BIGINT), 0)) AS BIGINT) AS requests,
  CAST(sum(COALESCE(TRY_CAST(NULLIF(regexp_extract(line, 'failures=(\\d+)', 1), '') AS BIGINT), 0)) AS BIGINT) AS failures,
  CAST(sum(COALESCE(TRY_CAST(NULLIF(regexp_extract(line, 'completion_tokens=(\\d+)', 1), '') AS BIGINT), 0)) AS BIGINT) AS completion_tokens
FROM ({_worker_sql(fx.DUCK)}) w""")
def q_load_tally(spark, sf):
    w = spark.sql(_worker_sql(fx.SPARK), conversations=tables.read(spark, sf, "conversations", "conv_id", "turn", "role", "text"))
    return TX.load_tally(w)
