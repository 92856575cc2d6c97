"""Registered queries: failure streaks, liveness, staleness, effective status, warm-up baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import histograms as HG
from ..operators import counters as C
from ..operators import state as ST
from ..operators import warmup as WU
from ..sources import fixtures as fx
from .registry import query

W_INC = "PARTITION BY engine_key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

_STREAK_SQL = fx.duck_cte("probes").rstrip("\n") + f""",
a AS (SELECT *, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER ({W_INC}) AS BIGINT) AS f_run FROM probes),
b AS (SELECT *, f_run - COALESCE(last_value(CASE WHEN success THEN f_run END IGNORE NULLS) OVER ({W_INC}), 0) AS streak FROM a),
c AS (SELECT *, last_value(CASE WHEN streak = 3 THEN ts END IGNORE NULLS) OVER ({W_INC}) AS third FROM b),
s AS (SELECT engine_key, ts, seq, success, status_type, streak, streak >= 3 AS stopped,
        CASE WHEN streak >= 3 THEN third END AS stopped_at FROM c)
"""


def streaks(spark, sf):
    return ST.failure_streak(fx.view(spark, sf, "probes"))


@query("failure_streak", _STREAK_SQL + "SELECT * FROM s")
def q_failure_streak(spark, sf):
    return streaks(spark, sf)


@query("liveness", _STREAK_SQL + "SELECT *, COALESCE(stopped AND ts - stopped_at > 30000, FALSE) AS removed FROM s")
def q_liveness(spark, sf):
    return ST.liveness(streaks(spark, sf))


@query("status_effective", _STREAK_SQL + """
SELECT engine_key, ts, seq, CASE WHEN success THEN status_type WHEN stopped THEN 'Stopped' ELSE 'Running' END AS status FROM s
""")
def q_status_effective(spark, sf):
    s = streaks(spark, sf)
    return s.select("engine_key", "ts", "seq",
                    ST.status_effective(F.col("status_type"), F.col("success"), F.col("stopped")).alias("status"))


@query("staleness", fx.duck_cte("engine_polls") + """
SELECT engine_key, ts, seq, next_ts, next_ts - ts AS gap_ms FROM (
  SELECT engine_key, ts, seq, lead(ts) OVER (PARTITION BY engine_key ORDER BY ts, seq) AS next_ts FROM engine_polls) x
WHERE next_ts - ts > 5000
""")
def q_staleness(spark, sf):
    p = fx.view(spark, sf, "engine_polls").select("engine_key", "ts", "seq")
    return ST.staleness(p, "engine_key")


# ---------------------------------------------------------------- warm-up

COUNTERS = ["prompt_tokens_total", "generation_tokens_total", "requests_total", "spec_accepted_total", "spec_draft_total", "spec_drafts_total",
            "ttft_count_total", "ttft_sum_total"]
TRIGGER = "ttft_count_total"
SKIP = 1


def epochs_cte(polls: str, at: str, tie: str) -> str:
    """CTEs: ``wp`` (polls in order), ``wm`` (the state after every poll, one poll at a time), ``we`` (with the epoch)."""
    vals = ", ".join(f"CAST({c} AS DOUBLE)" for c in COUNTERS)
    warm = f"NOT s.active AND p.total >= s.low AND p.total - s.low >= {SKIP}"
    lost = "s.active AND len(list_filter(list_zip(p.vals, s.base), lambda x: x[1] < x[2])) > 0"
    return f"""
wp AS (SELECT engine_key, {at}, {tie}, [{vals}] AS vals, CAST(coalesce(trunc({TRIGGER}), 0) AS BIGINT) AS total,
         row_number() OVER (PARTITION BY engine_key ORDER BY {at}, {tie}) AS n FROM {polls}),
wm AS (
  SELECT engine_key, n, {SKIP} = 0 AS active, {SKIP} = 0 AS just, total AS low, CASE WHEN {SKIP} = 0 THEN vals END AS base FROM wp WHERE n = 1
  UNION ALL
  SELECT p.engine_key, p.n, CASE WHEN s.active THEN NOT ({lost}) ELSE {warm} END, {warm}, CASE WHEN {lost} THEN p.total WHEN s.active THEN NULL ELSE least(s.low, p.total) END,
         CASE WHEN {warm} THEN p.vals WHEN s.active AND NOT ({lost}) THEN s.base END
  FROM wm s JOIN wp p ON p.engine_key = s.engine_key AND p.n = s.n + 1),
we AS (SELECT wp.*, active, just, base, max(CASE WHEN just THEN {at} END) OVER (PARTITION BY engine_key ORDER BY n) AS epoch FROM wm JOIN wp USING (engine_key, n))
"""


_WE = fx.duck_cte("engine_polls").rstrip("\n").replace("WITH", "WITH RECURSIVE", 1) + "," + epochs_cte("engine_polls", "ts", "seq")
_ADJUSTED = ", ".join(f"CASE WHEN base[{k}] IS NULL THEN vals[{k}] WHEN vals[{k}] IS NOT NULL THEN greatest(vals[{k}] - base[{k}], 0.0) END AS adj_{c}" for k, c in enumerate(COUNTERS, 1))
_WARMED = f"SELECT engine_key, ts, seq, NOT active AS warming_up, just AS just_transitioned, epoch, {_ADJUSTED} FROM we"


def warmup_input(spark, sf):
    return fx.view(spark, sf, "engine_polls").select("engine_key", "ts", "seq", *COUNTERS)


def warmed(spark, sf):
    return WU.baselined(warmup_input(spark, sf), COUNTERS, TRIGGER, SKIP)


@query("warmup_baseline", _WE + _WARMED)
def q_warmup_baseline(spark, sf):
    return warmed(spark, sf)


_RATES = ("prompt_tokens_total", "generation_tokens_total")


def _reset_sql() -> str:
    w = "PARTITION BY engine_key, epoch ORDER BY ts, seq"
    seen = ", ".join(f"last_value(CASE WHEN adj_{c} IS NOT NULL THEN {{'t': ts, 'v': adj_{c}}} END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p{k}" for k, c in enumerate(_RATES))
    rate = ", ".join(f"CASE WHEN ts > p{k}.t THEN (adj_{c} - p{k}.v) / ((ts - p{k}.t) / 1000.0) END AS {c}_rate" for k, c in enumerate(_RATES))
    avg = ", ".join(f"avg(CASE WHEN {c}_rate > 0 THEN {c}_rate END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}_avg" for c in _RATES)
    return _WE + f"""
, a AS ({_WARMED}),
q AS (SELECT *, {seen}, lag(adj_spec_accepted_total) OVER ({w}) AS pa, lag(adj_spec_draft_total) OVER ({w}) AS pd FROM a),
r AS (SELECT *, {rate},
        CASE WHEN adj_spec_accepted_total >= pa AND adj_spec_draft_total > pd THEN (adj_spec_accepted_total - pa) / (adj_spec_draft_total - pd) * 100.0 END AS acceptance_rate_live FROM q)
SELECT engine_key, ts, seq, epoch, {', '.join(f'{c}_rate' for c in _RATES)}, {avg}, acceptance_rate_live FROM r
"""


@query("rate_state_reset", _reset_sql())
def q_rate_state_reset(spark, sf):
    """Rates, running averages and live acceptance begin anew with every baseline: the key is (engine, epoch)."""
    w = warmed(spark, sf).withColumn("_epoch_key", F.concat_ws("#", "engine_key", F.col("epoch").cast("string")))
    w = w.select("_epoch_key", "engine_key", "ts", "seq", "epoch", *[f"adj_{c}" for c in (*_RATES, "spec_accepted_total", "spec_draft_total")]).checkpoint()
    d = C.counter_rate(w, "_epoch_key", "ts", "seq", [f"adj_{c}" for c in _RATES])
    d = C.live_acceptance(d, "_epoch_key", "ts", "seq", "adj_spec_accepted_total", "adj_spec_draft_total", "acceptance_rate_live")
    for c in _RATES:
        d = C.running_avg_rate(d.withColumnRenamed(f"adj_{c}_rate", f"{c}_rate"), F.col("_epoch_key"), "ts", "seq", f"{c}_rate", f"{c}_avg")
    return d.select("engine_key", "ts", "seq", "epoch", *[f"{c}_rate" for c in _RATES], *[f"{c}_avg" for c in _RATES], "acceptance_rate_live")


def _tick_polls_sql(polls: str, d) -> str:
    """The last poll of every engine and hour: the scrape that has the hour's histograms."""
    tick = f"{d.div('ts', '3600000')} * 3600000"
    return f"SELECT engine_key, tick_ts, CAST(0 AS BIGINT) AS seq, {', '.join(COUNTERS)} FROM (SELECT *, {tick} AS tick_ts, row_number() OVER (PARTITION BY engine_key, {tick} ORDER BY ts DESC, seq DESC) AS rn FROM {polls}) x WHERE rn = 1"


def _hist_cur_sql(d) -> str:
    """Histograms whose first bound is missing now and then, and one metric that is not in every scrape."""
    return (f"SELECT engine_key, tick_ts, metric, le, cum FROM {d.t('hist_buckets')} "
            f"WHERE NOT ({d.div('tick_ts', '3600000')} % 5 = 0 AND CAST(le AS {'VARCHAR' if d.name == 'duckdb' else 'STRING'}) = '0.001') AND NOT ({d.div('tick_ts', '3600000')} % 7 = 0 AND metric = 'tpot')")


_NAMED = ", ".join(f"('{c}', {c})" for c in COUNTERS)

_SUBTRACT_SQL = fx.duck_cte("engine_polls", "hist_buckets") + f"""SELECT * FROM (WITH RECURSIVE
tp AS ({_tick_polls_sql('engine_polls', fx.DUCK)}),{epochs_cte('tp', 'tick_ts', 'seq')},
c AS (SELECT h.*, e.active, e.epoch FROM ({_hist_cur_sql(fx.DUCK)}) h JOIN we e USING (engine_key, tick_ts)),
b AS (SELECT engine_key, epoch, metric, le, cum AS base FROM c WHERE tick_ts = epoch AND active),
bs AS (SELECT engine_key, epoch, metric, list_sort(list(le)) AS bset FROM b GROUP BY 1, 2, 3),
cs AS (SELECT engine_key, epoch, metric, tick_ts, list_sort(list(le)) AS cset FROM c GROUP BY 1, 2, 3, 4),
n AS (SELECT engine_key, epoch, tick_ts, active, base, unnest(range(1, {len(COUNTERS) + 1})) AS k, unnest(vals) AS v FROM we)
SELECT c.engine_key, c.epoch, c.tick_ts, c.metric, c.le, CASE WHEN NOT c.active OR b.base IS NULL THEN c.cum ELSE greatest(c.cum - b.base, 0.0) END AS cum
FROM c LEFT JOIN b USING (engine_key, epoch, metric, le) LEFT JOIN bs USING (engine_key, epoch, metric)
JOIN cs ON c.engine_key = cs.engine_key AND c.tick_ts = cs.tick_ts AND c.metric = cs.metric
WHERE NOT c.active OR bs.bset IS NULL OR bs.bset = cs.cset
UNION ALL
SELECT engine_key, epoch, tick_ts, ([{', '.join(f"'{c}'" for c in COUNTERS)}])[k], NULL, CASE WHEN NOT active OR base[k] IS NULL THEN v ELSE greatest(v - base[k], 0.0) END FROM n WHERE v IS NOT NULL
) q
"""


@query("baseline_subtract", _SUBTRACT_SQL)
def q_baseline_subtract(spark, sf):
    """Counters and histograms of every hourly scrape since the baseline of their epoch; the epochs come from the counters."""
    polls = spark.sql(_tick_polls_sql("{engine_polls}", fx.SPARK), engine_polls=fx.view(spark, sf, "engine_polls"))
    states = WU.epochs(polls, COUNTERS, TRIGGER, SKIP, ts="tick_ts")
    hist = HG.collect_buckets(spark.sql(_hist_cur_sql(fx.SPARK), hist_buckets=fx.view(spark, sf, "hist_buckets")), ["engine_key", "tick_ts", "metric"])
    hist = hist.select("engine_key", "tick_ts", "metric", F.lit(None).cast("double").alias("value"), F.col("buckets").alias("hist"))
    named = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in COUNTERS])
    counters = polls.select("engine_key", "tick_ts", F.inline(named)).where("value is not null").withColumn("hist", F.lit(None).cast(dict(hist.dtypes)["hist"]))
    out = WU.subtract_baseline(hist.unionByName(counters), states, "engine_key", "tick_ts")
    rows = F.when(F.col("hist").isNotNull(), F.col("hist")).otherwise(F.array(F.struct(F.lit(None).cast("double").alias("le"), F.col("value").alias("cum"))))
    return out.select("engine_key", "epoch", "tick_ts", "metric", F.inline(rows))
