"""Registered queries: counters, rates, trends, last-N, padding, series joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeutil import DAY_MS
from ..operators import counters as C
from ..operators import history as H
from ..operators import series as S
from ..operators.windows import trailing
from ..sources import fixtures as fx
from . import hardware_suite, joins_suite
from . import world as W
from .history_suite import _unpivot_tier_sql
from .registry import query

POLLS = fx.duck_cte("engine_polls")
CTR = ["prompt_tokens_total", "generation_tokens_total", "requests_total"]
PREV = "PARTITION BY engine_key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def polls(spark, sf):
    return fx.view(spark, sf, "engine_polls")


def _delta_sql():
    sel = []
    inner = []
    for c in CTR:
        inner.append(f"last_value({c} IGNORE NULLS) OVER ({PREV}) AS {c}_p")
        sel.append(f"CASE WHEN {c} >= {c}_p THEN {c} - {c}_p END AS {c}_delta")
    return POLLS + f"SELECT engine_key, ts, seq, {', '.join(CTR)}, {', '.join(sel)} FROM (SELECT *, {', '.join(inner)} FROM engine_polls) x"


@query("counter_delta", _delta_sql())
def q_counter_delta(spark, sf):
    d = polls(spark, sf).select("engine_key", "ts", "seq", *CTR)
    return C.counter_delta(d, "engine_key", "ts", "seq", CTR)


RATE = ["prompt_tokens_total", "generation_tokens_total"]


def _rate_sql():
    inner, sel = [], []
    for c in RATE:
        inner.append(f"last_value({c} IGNORE NULLS) OVER ({PREV}) AS {c}_p")
        inner.append(f"last_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER ({PREV}) AS {c}_pt")
        sel.append(
            f"CASE WHEN {c} IS NOT NULL AND {c}_p IS NOT NULL AND (ts - {c}_pt) / 1000.0 > 0 "
            f"THEN ({c} - {c}_p) / ((ts - {c}_pt) / 1000.0) END AS {c}_rate"
        )
    return f"SELECT engine_key, ts, seq, {', '.join(RATE)}, {', '.join(sel)} FROM (SELECT *, {', '.join(inner)} FROM engine_polls) x"


@query("counter_rate", POLLS + _rate_sql())
def q_counter_rate(spark, sf):
    d = polls(spark, sf).select("engine_key", "ts", "seq", *RATE)
    return C.counter_rate(d, "engine_key", "ts", "seq", RATE)


_RUNAVG_SQL = POLLS + f"""
, r AS ({_rate_sql()})
SELECT engine_key, ts, seq, generation_tokens_total_rate,
  sum(CASE WHEN generation_tokens_total_rate > 0 THEN generation_tokens_total_rate END)
    OVER (PARTITION BY engine_key, ts // {7 * DAY_MS} ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  / NULLIF(count(CASE WHEN generation_tokens_total_rate > 0 THEN 1 END)
    OVER (PARTITION BY engine_key, ts // {7 * DAY_MS} ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
  AS avg_tokens_per_sec
FROM r
"""


@query("running_avg_rate", _RUNAVG_SQL)
def q_running_avg_rate(spark, sf):
    r = q_counter_rate(spark, sf).select("engine_key", "ts", "seq", "generation_tokens_total_rate")
    # the fixture restarts engines weekly: the epoch key is (engine, week)
    epoch = F.concat_ws("#", F.col("engine_key"), F.floor(F.col("ts") / F.lit(7 * DAY_MS)).cast("string"))
    return C.running_avg_rate(r, epoch, "ts", "seq", "generation_tokens_total_rate", "avg_tokens_per_sec")


_LIVE_SQL = POLLS + """
SELECT engine_key, ts, seq, spec_accepted_total, spec_draft_total,
  CASE WHEN spec_accepted_total IS NOT NULL AND spec_draft_total IS NOT NULL AND pa IS NOT NULL AND pd IS NOT NULL
        AND spec_accepted_total >= pa AND spec_draft_total >= pd
        AND spec_draft_total - pd > 0 AND spec_accepted_total - pa >= 0
       THEN (spec_accepted_total - pa) / (spec_draft_total - pd) * 100.0 END AS acceptance_rate_live
FROM (SELECT *, lag(spec_accepted_total) OVER (PARTITION BY engine_key ORDER BY ts, seq) AS pa,
             lag(spec_draft_total) OVER (PARTITION BY engine_key ORDER BY ts, seq) AS pd FROM engine_polls) x
"""


@query("live_acceptance", _LIVE_SQL)
def q_live_acceptance(spark, sf):
    d = polls(spark, sf).select("engine_key", "ts", "seq", "spec_accepted_total", "spec_draft_total")
    return C.live_acceptance(d, "engine_key", "ts", "seq", "spec_accepted_total", "spec_draft_total", "acceptance_rate_live")


@query("spec_decode_ratios", POLLS + """
SELECT engine_key, ts, seq,
  CASE WHEN spec_draft_total > 0 AND spec_accepted_total >= 0 THEN spec_accepted_total / spec_draft_total * 100.0 END AS acceptance_rate,
  CASE WHEN spec_accepted_total IS NOT NULL AND spec_drafts_total > 0 THEN spec_accepted_total / spec_drafts_total END AS mean_acceptance_length
FROM engine_polls
""")
def q_spec_decode_ratios(spark, sf):
    d = polls(spark, sf)
    return d.select(
        "engine_key", "ts", "seq",
        C.spec_acceptance_rate(F.col("spec_accepted_total"), F.col("spec_draft_total")).alias("acceptance_rate"),
        C.spec_mean_acceptance_length(F.col("spec_accepted_total"), F.col("spec_drafts_total")).alias("mean_acceptance_length"),
    )


@query("counter_cast", POLLS + """
SELECT engine_key, ts, seq, spec_accepted_total - 1000.0 AS raw_value,
  CASE WHEN isnan(spec_accepted_total - 1000.0) OR spec_accepted_total - 1000.0 <= 0 THEN CAST(0 AS BIGINT)
       ELSE CAST(trunc(spec_accepted_total - 1000.0) AS BIGINT) END AS count_value
FROM engine_polls WHERE spec_accepted_total IS NOT NULL
""")
def q_counter_cast(spark, sf):
    d = polls(spark, sf).where(F.col("spec_accepted_total").isNotNull())
    v = F.col("spec_accepted_total") - 1000.0
    return d.select("engine_key", "ts", "seq", v.alias("raw_value"), C.counter_cast(v).alias("count_value"))


# ---------------------------------------------------------------- series over tiers

_HOURLY_PTS = f"hp AS ({_unpivot_tier_sql('snapshots_1h')})"
_DAILY_PTS = f"dp AS ({_unpivot_tier_sql('snapshots_1d')})"


def hourly_points(spark, sf):
    return H.unpivot_tier(W.hourly(spark, sf))


def daily_points(spark, sf):
    return H.unpivot_tier(W.daily(spark, sf))


KEYS = ["engine_key", "metric"]
SER = "PARTITION BY engine_key, metric ORDER BY timestamp_ms"


@query("trend", W.tier_cte() + f""", {_HOURLY_PTS}
SELECT engine_key, metric, timestamp_ms, value,
  CASE WHEN n < 6 OR onum < 3 THEN 'stable'
       WHEN oa = 0 THEN CASE WHEN ra > 0 THEN 'up' ELSE 'stable' END
       WHEN (ra - oa) / abs(oa) > 0.05 THEN 'up'
       WHEN (ra - oa) / abs(oa) < -0.05 THEN 'down'
       ELSE 'stable' END AS trend
FROM (SELECT *, count(*) OVER ({SER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n,
        avg(value) OVER ({SER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ra,
        avg(value) OVER ({SER} ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING) AS oa,
        count(*) OVER ({SER} ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING) AS onum FROM hp) x
""")
def q_trend(spark, sf):
    return S.trend(hourly_points(spark, sf), KEYS)


@query("trend_spark", W.tier_cte() + f""", {_HOURLY_PTS}
SELECT engine_key, metric, timestamp_ms, value,
  CASE WHEN a IS NULL THEN 'stable' WHEN value > a * 1.05 THEN 'up' WHEN value < a * 0.95 THEN 'down' ELSE 'stable' END AS trend
FROM (SELECT *, avg(value) OVER ({SER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a FROM hp) x
""")
def q_trend_spark(spark, sf):
    return S.trend_spark(hourly_points(spark, sf), KEYS)


@query("series_mean_line", W.tier_cte() + f""", {_HOURLY_PTS}
SELECT engine_key, metric, timestamp_ms, avg(value) OVER (PARTITION BY engine_key, metric) AS value FROM hp
""")
def q_series_mean_line(spark, sf):
    return S.series_mean_line(hourly_points(spark, sf), KEYS)


@query("downsample_stride", W.tier_cte() + f""", {_HOURLY_PTS}
SELECT engine_key, metric, timestamp_ms, value FROM (
  SELECT *, row_number() OVER ({SER}) - 1 AS i, count(*) OVER (PARTITION BY engine_key, metric) AS n FROM hp) x
WHERE n <= 60 OR i % CAST(ceil(n / 60.0) AS BIGINT) = 0 OR i = n - 1
""")
def q_downsample_stride(spark, sf):
    return S.downsample_stride(hourly_points(spark, sf), KEYS, 60)


@query("pad_left", W.tier_cte() + f""", {_DAILY_PTS},
f AS (SELECT engine_key, metric, count(*) AS n, min(timestamp_ms) AS t0,
        arg_min(value, timestamp_ms) AS v0 FROM dp GROUP BY 1, 2),
s AS (SELECT engine_key, metric, min(timestamp_ms) AS t1 FROM dp d
        WHERE timestamp_ms > (SELECT t0 FROM f WHERE f.engine_key = d.engine_key AND f.metric = d.metric) GROUP BY 1, 2)
SELECT engine_key, metric, timestamp_ms, value FROM dp
UNION ALL
SELECT f.engine_key, f.metric, t0 - k * COALESCE(s.t1 - t0, 1000) AS timestamp_ms, v0 AS value
FROM f LEFT JOIN s USING (engine_key, metric), range(1, 61) r(k)
WHERE n < 60 AND k <= 60 - n
""")
def q_pad_left(spark, sf):
    return S.pad_left(daily_points(spark, sf), KEYS, 60)


@query("last_n", W.tier_cte() + """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY engine_key
  ORDER BY ts DESC, total_requests DESC, power_watts DESC) AS rn FROM snapshots_1s) x WHERE rn <= 900
""")
def q_last_n(spark, sf):
    return S.last_n(W.raw(spark, sf), ["engine_key"], [F.col("ts"), F.col("total_requests"), F.col("power_watts")], 900)


_READINGS = hardware_suite._EVENTS.replace("WITH r AS", "r AS").strip()

_TRAILING_SQL = W.tier_cte() + f""", {_READINGS},
spans(span, ms) AS (VALUES ('5m', 300000), ('10m', 600000), ('15m', 900000)),
ticks AS (SELECT engine_key, max(ts) AS latest FROM snapshots_1s GROUP BY 1),
points AS (SELECT 'series' AS kind, engine_key AS owner, ts AS time_ms, prompt_tps AS value, latest FROM snapshots_1s JOIN ticks USING (engine_key)),
evs AS (SELECT 'event' AS kind, host AS owner, ts AS time_ms, CAST(gpu_index * 10 + ord AS DOUBLE) AS value, latest FROM e JOIN (SELECT host, max(ts) AS latest FROM r GROUP BY 1) l USING (host)),
reqs AS (
  SELECT 'request' AS kind, engine_key AS owner, epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS time_ms, value, latest
  FROM (SELECT 'engine-' || CAST(user_id % 8 AS VARCHAR) AS engine_key, ts, value FROM events) x JOIN ticks USING (engine_key))
SELECT s.span, kind, owner, time_ms, value FROM (SELECT * FROM points UNION ALL SELECT * FROM evs UNION ALL SELECT * FROM reqs) p JOIN spans s ON p.time_ms >= p.latest - s.ms
"""


@query("trailing_window", _TRAILING_SQL)
def q_trailing_window(spark, sf):
    """Series points, GPU events and request spans (by their end) of the last 5, 10 and 15 minutes of each engine or host."""
    raw = W.raw(spark, sf).select("engine_key", "ts", "prompt_tps")
    shown = lambda df, kind, owner, at, value: df.select("span", F.lit(kind).alias("kind"), F.col(owner).alias("owner"), F.col(at).alias("time_ms"), value.cast("double").alias("value"))
    points = shown(trailing(raw, raw, ["engine_key"], "ts"), "series", "engine_key", "ts", F.col("prompt_tps"))
    evs, ticks = hardware_suite.events(spark, sf), hardware_suite.readings(spark, sf)
    events = shown(trailing(evs, ticks, ["host"], "ts"), "event", "host", "ts", F.col("gpu_index") * 10 + F.col("ord"))
    spans = joins_suite.request_spans(spark, sf)
    requests = shown(trailing(spans, raw, ["engine_key"], "end_ms"), "request", "engine_key", "end_ms", F.col("tokens_per_sec"))
    return points.unionByName(events).unionByName(requests)


# ---------------------------------------------------------------- series joins

def _bucket_one(raw, metric: str, b: int):
    return H.bucket_raw(raw, b, [metric]).drop("metric")


_B1 = f"""(SELECT engine_key, (ts // 60000) * 60000 AS timestamp_ms, COALESCE(AVG(prompt_tps), 0) AS value
           FROM snapshots_1s GROUP BY 1, 2)"""
_B2 = f"""(SELECT engine_key, (ts // 420000) * 420000 AS timestamp_ms, COALESCE(MAX(CAST(active_requests AS DOUBLE)), 0) AS value
           FROM snapshots_1s GROUP BY 1, 2)"""
_B3 = f"""(SELECT engine_key, (ts // 90000) * 90000 AS timestamp_ms, COALESCE(AVG(decode_tps), 0) AS value
           FROM snapshots_1s GROUP BY 1, 2)"""


@query("per_request_rate", W.tier_cte() + f""",
t AS {_B1}, q AS (SELECT * FROM {_B2} WHERE engine_key <> 'engine-5'),
u AS (SELECT engine_key, timestamp_ms, value AS tps, NULL::DOUBLE AS rq, 1 AS k FROM t
      UNION ALL SELECT engine_key, timestamp_ms, NULL, value, 0 FROM q),
n AS (SELECT *,
  last_value(CASE WHEN k = 0 THEN timestamp_ms END IGNORE NULLS) OVER (PARTITION BY engine_key ORDER BY timestamp_ms, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bt,
  last_value(CASE WHEN k = 0 THEN rq END IGNORE NULLS) OVER (PARTITION BY engine_key ORDER BY timestamp_ms, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bv,
  first_value(CASE WHEN k = 0 THEN timestamp_ms END IGNORE NULLS) OVER (PARTITION BY engine_key ORDER BY timestamp_ms, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ft,
  first_value(CASE WHEN k = 0 THEN rq END IGNORE NULLS) OVER (PARTITION BY engine_key ORDER BY timestamp_ms, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fv
  FROM u),
m AS (SELECT n.*, CASE WHEN bt IS NULL THEN fv WHEN ft IS NULL THEN bv WHEN ft - timestamp_ms < timestamp_ms - bt THEN fv ELSE bv END AS req,
        (SELECT count(*) FROM q WHERE q.engine_key = n.engine_key) > 0 AS has FROM n WHERE k = 1)
SELECT engine_key, timestamp_ms, CASE WHEN NOT has THEN 0.0 WHEN req > 0 THEN tps / req ELSE 0.0 END AS value FROM m
""")
def q_per_request_rate(spark, sf):
    raw = W.raw(spark, sf)
    tps = _bucket_one(raw, "prompt_tps", 60_000)
    reqs = _bucket_one(raw, "active_requests", 420_000).where(F.col("engine_key") != "engine-5")
    return S.per_request_rate(tps, reqs, "engine_key")


@query("series_sum", W.tier_cte() + f"""
SELECT COALESCE(a.engine_key, b.engine_key) AS engine_key, COALESCE(a.timestamp_ms, b.timestamp_ms) AS timestamp_ms,
  COALESCE(a.value, 0) + COALESCE(b.value, 0) AS value
FROM {_B1} a FULL OUTER JOIN {_B3} b ON a.engine_key = b.engine_key AND a.timestamp_ms = b.timestamp_ms
""")
def q_series_sum(spark, sf):
    raw = W.raw(spark, sf)
    return S.series_sum(_bucket_one(raw, "prompt_tps", 60_000), _bucket_one(raw, "decode_tps", 90_000), ["engine_key"])


MERGE_METRICS = ["prompt_tps", "decode_tps", "active_requests"]


@query("series_merge", W.tier_cte() + f""", {_HOURLY_PTS},
ds AS (SELECT engine_key, metric, timestamp_ms, value FROM (
  SELECT *, row_number() OVER ({SER}) - 1 AS i, count(*) OVER (PARTITION BY engine_key, metric) AS n FROM hp
  WHERE metric IN ('prompt_tps', 'decode_tps', 'active_requests')) x
  WHERE n <= 60 OR i % CAST(ceil(n / 60.0) AS BIGINT) = 0 OR i = n - 1)
SELECT engine_key, timestamp_ms,
  first(value) FILTER (WHERE metric = 'prompt_tps') AS s0,
  first(value) FILTER (WHERE metric = 'decode_tps') AS s1,
  first(value) FILTER (WHERE metric = 'active_requests') AS s2
FROM ds GROUP BY engine_key, timestamp_ms
""")
def q_series_merge(spark, sf):
    pts = hourly_points(spark, sf).where(F.col("metric").isin(*MERGE_METRICS))
    padded = S.pad_data(pts, KEYS, 60)
    return S.series_merge(padded, ["engine_key"], "metric", MERGE_METRICS)
