"""Registered queries: tiers, summaries, time series, calendar windows, cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeutil import DAY_MS, HOUR_MS
from ..operators import history as H
from ..operators import tiers as T
from ..operators.windows import prev_row
from ..sources import fixtures as fx
from ..sources import tables
from ..sources import tier_store as TS
from . import world as W
from .registry import query

NOW = W.NOW_MS

# Report windows (window_id, since_ms, until_ms): parameters, not data.
SUMMARY_WINDOWS = [
    (1, 0, NOW),
    (2, NOW - 12 * HOUR_MS, NOW),
    (3, NOW - 20 * 60_000, NOW),
    (4, W.DAY_CUT - 7 * DAY_MS, W.DAY_CUT),
]
SHORT_WINDOWS = [(1, NOW - HOUR_MS, NOW), (2, W.HOUR_CUT - HOUR_MS, W.HOUR_CUT)]
LONG_HOURLY_WINDOWS = [(1, NOW - DAY_MS, NOW)]
LONG_DAILY_WINDOWS = [(2, 0, NOW)]
MONTH_BUCKET = H.bucket_size_ms(30 * DAY_MS)


def _values(rows) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in rows) + ") t(window_id, since_ms, until_ms))"


def _cols(prefix: str, cols) -> str:
    return ", ".join(f"{prefix}{c}" for c in cols)


# ---------------------------------------------------------------- rollups

@query("rollup_1h", W.tier_cte() + "SELECT * FROM hourly_all")
def q_rollup_1h(spark, sf):
    return T.rollup_1h(W.stored(spark, sf, "raw"), NOW)


@query("rollup_1d", W.tier_cte() + "SELECT * FROM snapshots_1d")
def q_rollup_1d(spark, sf):
    return T.rollup_1d(T.rollup_1h(W.stored(spark, sf, "raw"), NOW), NOW)


# ---------------------------------------------------------------- summaries

_RAW_SUMMARY = """
SELECT w.window_id, s.engine_key,
  CAST(COALESCE(SUM(total_prompt_tokens), 0) AS BIGINT) AS delta_prompt_tokens,
  CAST(COALESCE(SUM(total_gen_tokens), 0) AS BIGINT) AS delta_gen_tokens,
  CAST(COALESCE(SUM(total_requests), 0) AS BIGINT) AS total_requests,
  COALESCE(AVG(decode_tps), 0) AS avg_decode_tps,
  COALESCE(AVG(prompt_tps), 0) AS avg_prompt_tps,
  CAST(COALESCE(MAX(active_requests), 0) AS BIGINT) AS peak_active_requests,
  CAST(COALESCE(MAX(queued_requests), 0) AS BIGINT) AS peak_queued_requests,
  MAX(kv_cache_pct) AS peak_kv_cache_pct,
  AVG(kv_cache_pct) AS avg_kv_cache_pct,
  CAST(MAX(preemptions_total) AS BIGINT) AS total_preemptions,
  COALESCE(SUM(power_watts), 0) / 3600.0 / 1000.0 AS power_kwh,
  CAST(COUNT(*) AS DOUBLE) AS total_seconds
FROM {table} s JOIN {win} w ON s.ts >= w.since_ms AND s.ts <= w.until_ms
GROUP BY w.window_id, s.engine_key
"""

_TIER_SUMMARY = """
SELECT w.window_id, s.engine_key,
  CAST(COALESCE(SUM(total_prompt_tokens), 0) AS BIGINT) AS delta_prompt_tokens,
  CAST(COALESCE(SUM(total_gen_tokens), 0) AS BIGINT) AS delta_gen_tokens,
  CAST(COALESCE(SUM(total_requests), 0) AS BIGINT) AS total_requests,
  COALESCE(SUM(decode_tps_avg * sample_count) / NULLIF(SUM(sample_count), 0), 0) AS avg_decode_tps,
  COALESCE(SUM(prompt_tps_avg * sample_count) / NULLIF(SUM(sample_count), 0), 0) AS avg_prompt_tps,
  CAST(COALESCE(MAX(active_requests_max), 0) AS BIGINT) AS peak_active_requests,
  CAST(COALESCE(MAX(queued_requests_max), 0) AS BIGINT) AS peak_queued_requests,
  MAX(kv_cache_pct_max) AS peak_kv_cache_pct,
  SUM(kv_cache_pct_avg * sample_count) / NULLIF(SUM(sample_count), 0) AS avg_kv_cache_pct,
  CAST(MAX(preemptions_total) AS BIGINT) AS total_preemptions,
  COALESCE(SUM(power_watts_sum), 0) / 3600.0 / 1000.0 AS power_kwh,
  CAST(COALESCE(SUM(sample_count), 0) AS DOUBLE) AS total_seconds
FROM {table} s JOIN {win} w ON s.bucket_ts >= w.since_ms AND s.bucket_ts <= w.until_ms
GROUP BY w.window_id, s.engine_key
"""


@query("summary_raw", W.tier_cte() + _RAW_SUMMARY.format(table="snapshots_1s", win=_values(SUMMARY_WINDOWS)))
def q_summary_raw(spark, sf):
    return H.summary_raw(W.stored(spark, sf, "raw"), SUMMARY_WINDOWS)


@query("summary_weighted", W.tier_cte() + _TIER_SUMMARY.format(table="snapshots_1h", win=_values(SUMMARY_WINDOWS)))
def q_summary_weighted(spark, sf):
    return H.summary_weighted(W.stored(spark, sf, "hour").where(F.col("bucket_ts") >= W.RETAIN_CUT), SUMMARY_WINDOWS)


_CASCADE_SQL = W.tier_cte() + f""",
u AS (
  SELECT *, 1 AS tier_rank, 'daily' AS source_table FROM ({_TIER_SUMMARY.format(table='snapshots_1d', win=_values(SUMMARY_WINDOWS))})
  UNION ALL
  SELECT *, 2, 'hourly' FROM ({_TIER_SUMMARY.format(table='snapshots_1h', win=_values(SUMMARY_WINDOWS))})
  UNION ALL
  SELECT *, 3, 'raw' FROM ({_RAW_SUMMARY.format(table='raw_rest', win=_values(SUMMARY_WINDOWS))})
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY window_id, engine_key ORDER BY tier_rank) AS rn
  FROM u WHERE delta_prompt_tokens > 0 OR delta_gen_tokens > 0 OR total_requests > 0
)
SELECT * EXCLUDE (rn, tier_rank) FROM r WHERE rn = 1
"""


@query("summary_cascade", _CASCADE_SQL)
def q_summary_cascade(spark, sf):
    raw, hour, day = (W.stored(spark, sf, t) for t in ("raw", "hour", "day"))
    return H.summary_cascade(T.raw_remainder(raw, NOW), T.hourly_retained(hour, NOW), day, SUMMARY_WINDOWS)


# ---------------------------------------------------------------- time series

def _unpivot_tier_sql(table: str) -> str:
    arms = []
    for m, (_, agg) in H.METRIC_COLUMNS.items():
        if agg is None:
            continue
        v = f"CAST({agg} AS DOUBLE)"
        if m == "power_watts":
            v = f"CAST({agg} AS DOUBLE) / NULLIF(sample_count, 0)"
        arms.append(f"SELECT engine_key, '{m}' AS metric, bucket_ts AS timestamp_ms, COALESCE({v}, 0) AS value FROM {table}")
    return " UNION ALL ".join(arms)


def _bucket_raw_sql(table: str, bucket_ms: int, win: str | None = None) -> str:
    arms = []
    for m, (raw, _) in H.METRIC_COLUMNS.items():
        agg = "MAX" if m in H.MAX_METRICS else "AVG"
        wsel = "w.window_id, " if win else ""
        wjoin = f" JOIN {win} w ON s.ts >= w.since_ms AND s.ts <= w.until_ms" if win else ""
        wgrp = "w.window_id, " if win else ""
        arms.append(
            f"SELECT {wsel}engine_key, '{m}' AS metric, (ts // {bucket_ms}) * {bucket_ms} AS timestamp_ms, "
            f"COALESCE({agg}(CAST({raw} AS DOUBLE)), 0) AS value FROM {table} s{wjoin} "
            f"GROUP BY {wgrp}engine_key, (ts // {bucket_ms}) * {bucket_ms}"
        )
    return " UNION ALL ".join(arms)


_SHORT_SQL = W.tier_cte() + f"""
SELECT w.window_id, p.engine_key, p.metric, p.timestamp_ms, p.value, 'hourly' AS source
FROM ({_unpivot_tier_sql('snapshots_1h')}) p JOIN {_values(SHORT_WINDOWS)} w
  ON p.timestamp_ms >= w.since_ms AND p.timestamp_ms <= w.until_ms
UNION ALL
SELECT window_id, engine_key, metric, timestamp_ms, value, 'raw' AS source
FROM ({_bucket_raw_sql('raw_rest', H.bucket_size_ms(HOUR_MS), _values(SHORT_WINDOWS))}) r
"""


@query("timeseries_short", _SHORT_SQL)
def q_timeseries_short(spark, sf):
    raw, hour = (W.stored(spark, sf, t) for t in ("raw", "hour"))
    return H.timeseries_short(T.raw_remainder(raw, NOW), T.hourly_retained(hour, NOW), SHORT_WINDOWS, HOUR_MS)


_LONG_SQL = W.tier_cte() + f"""
SELECT w.window_id, p.engine_key, p.metric, p.timestamp_ms, p.value
FROM ({_unpivot_tier_sql('snapshots_1h')}) p JOIN {_values(LONG_HOURLY_WINDOWS)} w
  ON p.timestamp_ms >= w.since_ms AND p.timestamp_ms <= w.until_ms
UNION ALL
SELECT w.window_id, p.engine_key, p.metric, p.timestamp_ms, p.value
FROM ({_unpivot_tier_sql('snapshots_1d')}) p JOIN {_values(LONG_DAILY_WINDOWS)} w
  ON p.timestamp_ms >= w.since_ms AND p.timestamp_ms <= w.until_ms
"""


@query("timeseries_long", _LONG_SQL)
def q_timeseries_long(spark, sf):
    assert H.choose_tier(DAY_MS) == "hourly" and H.choose_tier(NOW) == "daily"
    a = H.timeseries_long(T.hourly_retained(W.stored(spark, sf, "hour"), NOW), LONG_HOURLY_WINDOWS)
    b = H.timeseries_long(W.stored(spark, sf, "day"), LONG_DAILY_WINDOWS)
    return a.unionByName(b)


@query("bucket_agg_policy", W.tier_cte() + _bucket_raw_sql("snapshots_1s", MONTH_BUCKET))
def q_bucket_agg_policy(spark, sf):
    return H.bucket_raw(W.raw(spark, sf), MONTH_BUCKET)


@query("metric_resolve", W.tier_cte() + _unpivot_tier_sql("snapshots_1h"))
def q_metric_resolve(spark, sf):
    metrics = list(H.METRIC_COLUMNS) + ["not_a_metric"]  # unknown name resolves to nothing
    return H.unpivot_tier(W.hourly(spark, sf), [m for m in metrics if H.resolve_metric(m)])


# Scan requests: the last k + 1 days of engine k, and an hour of every engine.
SCANS = [TS.Request(k, W.DAY_CUT - (k + 1) * DAY_MS, NOW, f"engine-{k}") for k in range(8)] + [TS.Request(8, W.DAY_CUT - 9 * DAY_MS, W.DAY_CUT - 9 * DAY_MS + HOUR_MS)]


def _scan_sql() -> str:
    rows = ", ".join(f"({r.id}, {r.since_ms}, {r.until_ms}, {repr(r.engine_key) if r.engine_key else 'NULL'})" for r in SCANS)
    return W.tier_cte() + f"""
SELECT r.request_id, s.* FROM snapshots_1s s JOIN (SELECT * FROM (VALUES {rows}) t(request_id, since_ms, until_ms, engine)) r
  ON (r.engine IS NULL OR r.engine = s.engine_key) AND s.ts >= r.since_ms AND s.ts <= r.until_ms
"""


@query("tier_scan", _scan_sql())
def q_tier_scan(spark, sf):
    return TS.scan(spark, W.store(spark, sf), "raw", SCANS)


_UNION_SQL = W.tier_cte() + f"""
SELECT engine_key, metric, timestamp_ms, value, 'hourly' AS source FROM ({_unpivot_tier_sql('snapshots_1h')}) a
UNION ALL
SELECT engine_key, metric, timestamp_ms, value, 'raw' AS source FROM ({_bucket_raw_sql('raw_rest', 1000)}) b
"""


@query("tier_union", _UNION_SQL)
def q_tier_union(spark, sf):
    a = H.unpivot_tier(W.hourly(spark, sf)).withColumn("source", F.lit("hourly"))
    b = H.bucket_raw(W.raw_remainder(spark, sf), 1000).withColumn("source", F.lit("raw"))
    cols = ["engine_key", "metric", "timestamp_ms", "value", "source"]
    return a.select(*cols).unionByName(b.select(*cols))


@query("series_order", W.tier_cte() + f"""
SELECT engine_key, metric, timestamp_ms, value,
  row_number() OVER (PARTITION BY engine_key, metric ORDER BY timestamp_ms) - 1 AS pos
FROM ({_unpivot_tier_sql('snapshots_1d')}) p
""")
def q_series_order(spark, sf):
    return H.series_order(H.unpivot_tier(W.daily(spark, sf)))


# ---------------------------------------------------------------- energy and cost

@query("energy_kwh", W.tier_cte() + """
SELECT engine_key, ts // 86400000 * 86400000 AS day_ts,
  SUM(power_watts) / 3600.0 / 1000.0 AS energy_kwh,
  SUM(power_watts * dt_ms) / 3600000000.0 AS energy_kwh_sampled
FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY engine_key ORDER BY ts, total_requests, power_watts) AS dt_ms FROM snapshots_1s) s
GROUP BY engine_key, ts // 86400000 * 86400000
""")
def q_energy_kwh(spark, sf):
    raw = W.raw(spark, sf).select("engine_key", "ts", "power_watts", "total_requests")
    tie = F.struct("total_requests", "power_watts")
    r = prev_row(raw.withColumn("_tie", tie), "engine_key", "ts", "_tie", ["power_watts"])
    dt = F.col("ts") - F.col("ts_lag")
    return r.groupBy("engine_key", (F.col("ts") - F.col("ts") % DAY_MS).alias("day_ts")).agg(
        H.energy_kwh(F.sum("power_watts")).alias("energy_kwh"),
        (F.sum(F.col("power_watts") * dt) / 3.6e9).alias("energy_kwh_sampled"),
    )


SETTINGS = {"cloud_prompt_rate": "0.15", "cloud_gen_rate": "0.60", "electricity_rate": " 0.12 $/kWh"}


def _settings_df(spark):
    return spark.createDataFrame([tuple(SETTINGS.values())], ", ".join(f"{k} string" for k in SETTINGS))


@query("cost_savings", _CASCADE_SQL.replace("SELECT * EXCLUDE (rn, tier_rank) FROM r WHERE rn = 1", """
, c AS (SELECT * EXCLUDE (rn, tier_rank) FROM r WHERE rn = 1)
SELECT c.*,
  delta_prompt_tokens / 1000000.0 * 0.15 + delta_gen_tokens / 1000000.0 * 0.60 AS cloud_cost,
  power_kwh * 0.12 AS energy_cost,
  (delta_prompt_tokens / 1000000.0 * 0.15 + delta_gen_tokens / 1000000.0 * 0.60) - power_kwh * 0.12 AS net_savings,
  total_seconds / 3600.0 AS hours_alive
FROM c
"""))
def q_cost_savings(spark, sf):
    s = q_summary_cascade(spark, sf)
    return H.cost_savings(s, _settings_df(spark))


# ---------------------------------------------------------------- calendar

def _orders_now(d):
    return f"SELECT o_orderkey, {d.ms('o_orderdate')} + 50400000 AS now_ms, CAST(o_orderkey % 25 - 12 AS INT) AS utc_offset FROM {d.t('orders')}"


_CAL_SQL = f"""
WITH o AS ({_orders_now(fx.DUCK)}),
b AS (
  SELECT o_orderkey, now_ms, utc_offset, CAST(utc_offset AS BIGINT) * 3600000 AS off,
         DATE '1970-01-01' + CAST((now_ms + CAST(utc_offset AS BIGINT) * 3600000) // 86400000 AS INTEGER) AS d
  FROM o
),
c AS (
  SELECT *, d - CAST(dayofweek(d) AS INTEGER) AS wk, d - CAST(day(d) - 1 AS INTEGER) AS m0,
         make_date(year(d), 1, 1) AS y0 FROM b
),
e AS (
  SELECT *, CAST(m0 + INTERVAL 1 MONTH AS DATE) AS m1, CAST(m0 - INTERVAL 1 MONTH AS DATE) AS mm1 FROM c
)
SELECT o_orderkey, now_ms, utc_offset, p.preset, p.since_ms, p.until_ms FROM e, LATERAL (
  SELECT 'today' AS preset, (d - DATE '1970-01-01') * 86400000 - off AS since_ms, now_ms AS until_ms
  UNION ALL SELECT 'this_week', (wk - DATE '1970-01-01') * 86400000 - off, least((wk + 7 - DATE '1970-01-01') * 86400000 - off, now_ms)
  UNION ALL SELECT 'this_month', (m0 - DATE '1970-01-01') * 86400000 - off, least((m1 - DATE '1970-01-01') * 86400000 - off, now_ms)
  UNION ALL SELECT 'last_month', (mm1 - DATE '1970-01-01') * 86400000 - off, (m0 - DATE '1970-01-01') * 86400000 - off
  UNION ALL SELECT 'this_year', (y0 - DATE '1970-01-01') * 86400000 - off, now_ms
  UNION ALL SELECT 'all_time', 0, now_ms
  UNION ALL SELECT 'custom', now_ms - o_orderkey % 1000 * 3600000, CASE WHEN o_orderkey % 2 = 0 THEN now_ms ELSE now_ms - 60000 END
  UNION ALL SELECT 'last_decade', (d - DATE '1970-01-01') * 86400000 - off, now_ms
) p
"""


@query("calendar_window", _CAL_SQL)
def q_calendar_window(spark, sf):
    """Every preset, a custom range (every other one open) and a preset that nobody knows."""
    o = spark.sql(_orders_now(fx.SPARK), orders=tables.read(spark, sf, "orders", "o_orderkey", "o_orderdate"))
    asked = o.withColumn("preset", F.explode(F.array(*[F.lit(p) for p in (*H.PRESETS, "custom", "last_decade")]))).withColumn(
        "custom_since", F.col("now_ms") - F.col("o_orderkey") % 1000 * HOUR_MS).withColumn("custom_until", F.when(F.col("o_orderkey") % 2 == 1, F.col("now_ms") - 60_000))
    return H.chosen_window(asked, F.col("utc_offset")).select(
        "o_orderkey", "now_ms", "utc_offset", "preset", "since_ms", "until_ms")
