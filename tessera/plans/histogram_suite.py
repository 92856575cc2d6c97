"""Registered queries: histogram percentiles, fractions, goodput, SLO thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import histograms as HG
from ..operators import slo as SLO
from ..sources import fixtures as fx
from ..sources import tables
from .registry import query

QS = (0.5, 0.95, 0.99)
THRESHOLDS_S = (0.05, 0.5, 2.0)
HK = ["engine_key", "tick_ts", "metric"]


def buckets(spark, sf):
    return HG.collect_buckets(fx.view(spark, sf, "hist_buckets"), HK)


# Oracle: the exploded (one row per bucket) form with lag(le, cum) and first match.
_H = fx.duck_cte("hist_buckets").rstrip("\n") + """,
h AS (
  SELECT engine_key, tick_ts, metric, le, cum,
    lag(le, 1, 0.0) OVER w AS ple, lag(cum, 1, 0.0) OVER w AS pcum, row_number() OVER w AS i,
    max(cum) OVER (PARTITION BY engine_key, tick_ts, metric) AS total,
    max(CASE WHEN le <> 'Infinity'::DOUBLE THEN le END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower_fin
  FROM hist_buckets WINDOW w AS (PARTITION BY engine_key, tick_ts, metric ORDER BY le)
)
"""

def _pct_ctes() -> str:
    return _H + f""",
qs AS (SELECT unnest([{', '.join(map(str, QS))}]) AS q),
hit AS (
  SELECT h.engine_key, h.tick_ts, h.metric, qs.q, arg_min(h, h.le) AS b
  FROM h, qs WHERE h.cum >= h.total * qs.q GROUP BY 1, 2, 3, 4
),
keys AS (SELECT DISTINCT engine_key, tick_ts, metric, total FROM h),
p AS (
SELECT k.engine_key, k.tick_ts, k.metric, qs.q,
  CASE WHEN k.total <= 0 OR hit.b IS NULL THEN NULL
       WHEN hit.b.le = 'Infinity'::DOUBLE THEN hit.b.lower_fin
       WHEN hit.b.cum - hit.b.pcum <= 0 OR hit.b.le - hit.b.ple <= 0 THEN hit.b.le
       ELSE hit.b.ple + (k.total * qs.q - hit.b.pcum) / (hit.b.cum - hit.b.pcum) * (hit.b.le - hit.b.ple) END AS value
FROM keys k CROSS JOIN qs LEFT JOIN hit ON hit.engine_key = k.engine_key AND hit.tick_ts = k.tick_ts
  AND hit.metric = k.metric AND hit.q = qs.q
)
"""


_PCT_SQL = _pct_ctes() + "SELECT * FROM p"
_LATPCT_SQL = _pct_ctes() + "SELECT engine_key, tick_ts,\n" + ",\n".join(
    f"  max(CASE WHEN metric = '{m}' AND q = {q} THEN value * 1000 END) AS {m}_p{int(round(q * 100))}_ms"
    for m, _ in fx.HIST_SCALE for q in QS) + "\nFROM p GROUP BY engine_key, tick_ts"


@query("hist_percentile", _PCT_SQL)
def q_hist_percentile(spark, sf):
    b = buckets(spark, sf)
    qarr = F.array(*[F.lit(q) for q in QS])
    return b.select(*HK, F.explode(qarr).alias("q"), "buckets").select(
        *HK, "q", F.expr(HG.percentile_sql("buckets", "q")).alias("value"))


@query("latency_percentiles", _LATPCT_SQL)
def q_latency_percentiles(spark, sf):
    b = buckets(spark, sf)
    per = b.groupBy("engine_key", "tick_ts").pivot("metric", [m for m, _ in fx.HIST_SCALE]).agg(F.first("buckets"))
    cols = []
    for m, _ in fx.HIST_SCALE:
        for q in QS:
            cols.append((F.expr(HG.percentile_sql(f"`{m}`", repr(q))) * 1000).alias(f"{m}_p{int(round(q * 100))}_ms"))
    return per.select("engine_key", "tick_ts", *cols)


def _frac_ctes(ts_cte: str, by_metric: bool, by_engine: bool) -> str:
    """Oracle CTEs ending in ``g(engine_key, tick_ts, metric, thr, fraction)``; ``ts`` holds thresholds."""
    on_h = " AND ".join(["TRUE"] + (["ts.m = h.metric"] if by_metric else []) + (["ts.ek = h.engine_key"] if by_engine else []))
    on_f = " AND ".join(["TRUE"] + (["ts.m = f.metric"] if by_metric else []) + (["ts.ek = f.engine_key"] if by_engine else []))
    return _H + f""",
ts AS ({ts_cte}),
firsts AS (SELECT engine_key, tick_ts, metric, le AS fle, cum AS fcum, total FROM h WHERE i = 1),
hit AS (
  SELECT h.engine_key, h.tick_ts, h.metric, ts.thr, arg_min(h, h.le) AS b
  FROM h JOIN ts ON {on_h} WHERE h.le = 'Infinity'::DOUBLE OR h.le >= ts.thr GROUP BY 1, 2, 3, 4
),
g AS (
SELECT f.engine_key, f.tick_ts, f.metric, ts.thr,
  CASE WHEN f.total <= 0 THEN NULL
       WHEN ts.thr <= f.fle AND f.fle <> 'Infinity'::DOUBLE THEN
         CASE WHEN f.fle <= 0 THEN 0.0 ELSE least(greatest(f.fcum * least(greatest(ts.thr / f.fle, 0.0), 1.0) / f.total, 0.0), 1.0) END
       WHEN hit.b IS NULL THEN 1.0
       WHEN hit.b.le = 'Infinity'::DOUBLE THEN least(greatest(hit.b.pcum / f.total, 0.0), 1.0)
       WHEN hit.b.le - hit.b.ple <= 0 OR hit.b.cum - hit.b.pcum <= 0 THEN least(greatest(hit.b.pcum / f.total, 0.0), 1.0)
       ELSE least(greatest((hit.b.pcum + (ts.thr - hit.b.ple) / (hit.b.le - hit.b.ple) * (hit.b.cum - hit.b.pcum)) / f.total, 0.0), 1.0)
  END AS fraction
FROM firsts f JOIN ts ON {on_f} LEFT JOIN hit ON hit.engine_key = f.engine_key AND hit.tick_ts = f.tick_ts
  AND hit.metric = f.metric AND hit.thr = ts.thr
)
"""


_FRAC_SQL = _frac_ctes(f"SELECT unnest([{', '.join(map(str, THRESHOLDS_S))}]) AS thr", False, False) + "SELECT * FROM g"

_DEFAULT_TS = "SELECT * FROM (VALUES ('ttft', 500 / 1000.0), ('itl', 50 / 1000.0), ('e2e', 5000 / 1000.0), ('tpot', 50 / 1000.0)) t(m, thr)"
_GP_SELECT = """SELECT engine_key, tick_ts,
  max(CASE WHEN metric = 'ttft' THEN 100.0 * fraction END) AS ttft_goodput_pct,
  max(CASE WHEN metric = 'itl' THEN 100.0 * fraction END) AS itl_goodput_pct,
  max(CASE WHEN metric = 'e2e' THEN 100.0 * fraction END) AS e2e_goodput_pct,
  max(CASE WHEN metric = 'tpot' THEN 100.0 * fraction END) AS tpot_goodput_pct
FROM g GROUP BY engine_key, tick_ts"""
_GOODPUT_SQL = _frac_ctes(_DEFAULT_TS, True, False) + _GP_SELECT


@query("hist_fraction_le", _FRAC_SQL)
def q_hist_fraction_le(spark, sf):
    b = buckets(spark, sf)
    tarr = F.array(*[F.lit(t) for t in THRESHOLDS_S])
    return b.select(*HK, F.explode(tarr).alias("thr"), "buckets").select(
        *HK, "thr", F.expr(HG.fraction_le_sql("buckets", "thr")).alias("fraction"))


def goodputs(spark, sf, slo=None):
    slo = slo or SLO.DEFAULT_SLO
    b = buckets(spark, sf)
    per = b.groupBy("engine_key", "tick_ts").pivot("metric", [m for m, _ in fx.HIST_SCALE]).agg(F.first("buckets"))
    return per.select(
        "engine_key", "tick_ts",
        *[HG.goodput_pct(m, slo[m]).alias(f"{m}_goodput_pct") for m, _ in fx.HIST_SCALE],
    )


@query("goodput", _GOODPUT_SQL)
def q_goodput(spark, sf):
    return goodputs(spark, sf)


@query("goodput_combined", _frac_ctes(_DEFAULT_TS, True, False) + ", gp AS (" + _GP_SELECT + """)
SELECT engine_key, tick_ts, least(ttft_goodput_pct, itl_goodput_pct, e2e_goodput_pct) AS combined_goodput_pct FROM gp""")
def q_goodput_combined(spark, sf):
    g = goodputs(spark, sf)
    return g.select("engine_key", "tick_ts",
                    HG.goodput_combined(F.col("ttft_goodput_pct"), F.col("itl_goodput_pct"), F.col("e2e_goodput_pct")).alias("combined_goodput_pct"))


def _more_totals_sql(d) -> str:
    """Queue time (seconds) and batch size: _sum and _count per (engine, hour)."""
    tick = f"{d.div(d.ms('ts'), '3600000')} * 3600000"
    s = f"""
SELECT engine_key, tick_ts, metric, CAST(CASE metric WHEN 'queue' THEN queue_us ELSE batch_us END AS DOUBLE) / 1000000.0 AS sum_s, CAST(cnt AS DOUBLE) AS count
FROM (SELECT 'engine-' || CAST(user_id % 8 AS STRING) AS engine_key, {tick} AS tick_ts, sum(CASE WHEN event_type <> 'error' THEN CAST(floor(value * 250) AS BIGINT) ELSE 0 END) AS queue_us,
        sum(CASE WHEN event_type <> 'error' THEN (event_id % 16) * 1000000 ELSE 0 END) AS batch_us, count_if(event_type <> 'error') AS cnt
      FROM {d.t('events')} GROUP BY 1, 2) u CROSS JOIN (SELECT 'queue' AS metric UNION ALL SELECT 'batch') m"""
    return s.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


@query("hist_average", fx.duck_cte("hist_totals") + f"""
SELECT engine_key, tick_ts, metric, CASE WHEN count > 0 THEN sum_s / count * CASE WHEN metric = 'batch' THEN 1.0 ELSE 1000.0 END END AS average
FROM (SELECT engine_key, tick_ts, metric, sum_s, count FROM hist_totals UNION ALL {_more_totals_sql(fx.DUCK)}) t
""")
def q_hist_average(spark, sf):
    """The four latencies and the queue time in milliseconds, and the batch size; hours without an observation have none."""
    more = spark.sql(_more_totals_sql(fx.SPARK), events=tables.read(spark, sf, "events", "ts", "user_id", "event_id", "event_type", "value"))
    t = fx.view(spark, sf, "hist_totals").select(*more.columns).unionByName(more)
    scale = F.when(F.col("metric") == "batch", 1.0).otherwise(1000.0)
    return t.select("engine_key", "tick_ts", "metric", HG.hist_average(F.col("sum_s"), F.col("count"), scale).alias("average"))


@query("ratio_metrics", fx.duck_cte("engine_polls") + """
SELECT engine_key, ts, seq,
  CASE WHEN ttft_sum_total > 0 AND prompt_tokens_total IS NOT NULL THEN prompt_tokens_total / ttft_sum_total END AS per_request_prompt_tps,
  CASE WHEN ttft_count_total > 0 AND ttft_sum_total > 0 THEN ttft_count_total / ttft_sum_total END AS per_request_tps,
  CASE WHEN generation_tokens_total > 0 AND requests_total IS NOT NULL THEN requests_total / generation_tokens_total * 100.0 END AS prefix_cache_hit_rate,
  CAST(active_requests AS DOUBLE) / 16.0 * 100.0 AS kv_cache_percent
FROM engine_polls
""")
def q_ratio_metrics(spark, sf):
    p = fx.view(spark, sf, "engine_polls")
    return p.select("engine_key", "ts", "seq", *SLO.ratio_metrics(
        prompt_total=F.col("prompt_tokens_total"), ttft_sum=F.col("ttft_sum_total"),
        tpot_count=F.col("ttft_count_total"), tpot_sum=F.col("ttft_sum_total"),
        hits=F.col("requests_total"), queries=F.col("generation_tokens_total"),
        kv_usage=F.col("active_requests").cast("double") / 16.0))


# ---------------------------------------------------------------- SLO thresholds

def _blob_sql(d) -> str:
    """Stored threshold blobs per (engine, model), written in p_partkey order (latest = max key)."""
    k = "p_partkey % 8"
    num = "CAST(p_size * 20 AS STRING)"
    body = (
        f"CASE WHEN p_size % 11 = 0 THEN 'not json' "
        f"WHEN p_size % 7 = 0 THEN chr(123) || '\"ttftMs\": \"fast\", \"itlMs\": 5, \"e2eMs\": 50' || chr(125) "
        f"ELSE chr(123) || '\"ttftMs\": ' || {num} || ', \"itlMs\": ' || CAST(p_size - 5 AS STRING) || ', \"e2eMs\": ' || CAST(p_size * 200 AS STRING)"
        f" || (CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ', \"tpotMs\": ' || CAST(p_size % 4 * 10 AS STRING) ELSE ', \"tpotMs\": 40' END) || chr(125) END"
    )
    sql = (f"SELECT p_partkey AS seq, 'engine-' || CAST({k} AS STRING) AS engine_key, {d.model_case(k)} AS model_name, "
           f"{body} AS raw FROM {d.t('part')}")
    return sql.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


_THRESH_SQL = fx.duck_cte("engine_snapshots").rstrip("\n") + f""",
blobs AS ({_blob_sql(fx.DUCK)}),
latest AS (SELECT engine_key, model_name, arg_max(raw, seq) AS raw FROM blobs WHERE model_name IS NOT NULL GROUP BY 1, 2),
parsed AS (
  SELECT engine_key, model_name,
    CASE WHEN json_valid(raw) THEN json_type(raw, '$.ttftMs') END AS tt, CASE WHEN json_valid(raw) THEN TRY_CAST(json_extract(raw, '$.ttftMs') AS DOUBLE) END AS ttft,
    CASE WHEN json_valid(raw) THEN json_type(raw, '$.itlMs') END AS it, CASE WHEN json_valid(raw) THEN TRY_CAST(json_extract(raw, '$.itlMs') AS DOUBLE) END AS itl,
    CASE WHEN json_valid(raw) THEN json_type(raw, '$.e2eMs') END AS et, CASE WHEN json_valid(raw) THEN TRY_CAST(json_extract(raw, '$.e2eMs') AS DOUBLE) END AS e2e,
    CASE WHEN json_valid(raw) THEN json_type(raw, '$.tpotMs') END AS pt, CASE WHEN json_valid(raw) THEN TRY_CAST(json_extract(raw, '$.tpotMs') AS DOUBLE) END AS tpot
  FROM latest
),
valid AS (
  SELECT engine_key, model_name, ttft, itl, e2e, COALESCE(tpot, 50.0) AS tpot FROM parsed
  WHERE tt IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND ttft > 0 AND it IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND itl > 0
    AND et IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND e2e > 0
    AND (pt IS NULL OR (pt IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND tpot > 0))
),
eng AS (SELECT DISTINCT engine_key, model_name FROM engine_snapshots)
SELECT e.engine_key, e.model_name,
  COALESCE(v.ttft, 500.0) AS ttft_ms, COALESCE(v.itl, 50.0) AS itl_ms, COALESCE(v.e2e, 5000.0) AS e2e_ms,
  COALESCE(v.tpot, 50.0) AS tpot_ms, v.engine_key IS NOT NULL AS is_customized
FROM eng e LEFT JOIN valid v ON v.engine_key = e.engine_key AND v.model_name = e.model_name
"""


def thresholds(spark, sf):
    blobs = spark.sql(_blob_sql(fx.SPARK), part=spark.read.parquet(f"{sf}/part.parquet"))
    eng = fx.engine_snapshots(spark, sf).select("engine_key", "model_name").distinct()
    return SLO.slo_thresholds(eng, blobs)


@query("slo_thresholds", _THRESH_SQL)
def q_slo_thresholds(spark, sf):
    return thresholds(spark, sf)


_TS_CUSTOM = ("SELECT engine_key AS ek, m, thr FROM th, LATERAL (SELECT * FROM (VALUES ('ttft', ttft_ms / 1000.0), "
              "('itl', itl_ms / 1000.0), ('e2e', e2e_ms / 1000.0), ('tpot', tpot_ms / 1000.0)) t(m, thr))")
_SLO_JOIN_SQL = (
    _frac_ctes(_TS_CUSTOM, True, True).replace(
        "WITH ", "WITH " + _THRESH_SQL.split("WITH ", 1)[1].replace(
            "SELECT e.engine_key, e.model_name,\n  COALESCE(v.ttft", ", th AS (SELECT e.engine_key, e.model_name,\n  COALESCE(v.ttft", 1
        ).rstrip() + "),\n", 1)
    + ", gp AS (" + _GP_SELECT + """)
SELECT s.engine_key, s.tick_ts, th.is_customized,
  COALESCE(gp.ttft_goodput_pct, s.ttft_goodput_pct) AS ttft_goodput_pct,
  COALESCE(gp.itl_goodput_pct, s.itl_goodput_pct) AS itl_goodput_pct,
  COALESCE(gp.e2e_goodput_pct, s.e2e_goodput_pct) AS e2e_goodput_pct
FROM engine_snapshots s JOIN th ON th.engine_key = s.engine_key AND th.model_name IS NOT DISTINCT FROM s.model_name
LEFT JOIN gp ON gp.engine_key = s.engine_key AND gp.tick_ts = s.tick_ts""")


@query("slo_join", _SLO_JOIN_SQL)
def q_slo_join(spark, sf):
    th = thresholds(spark, sf)
    snaps = fx.engine_snapshots(spark, sf)
    b = buckets(spark, sf)
    return SLO.slo_join(snaps, th, b)
