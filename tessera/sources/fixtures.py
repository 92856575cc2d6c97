"""Telemetry views derived from the provided tables.

The provided data carries no telemetry, so these views turn ``events``,
``part``, ``lineitem``, ``documents`` ... into the shapes the operators
consume (raw 1 s tier, engine snapshots, cumulative counters, histogram
buckets, probes, process tree, log chunks). Each view is one SQL text written
against a small ``Dialect`` so the very same derivation is rendered for Spark
(via ``spark.sql`` with DataFrame arguments, no global temp views) and for the
DuckDB oracle. Only the test input is shared; every operator is implemented
separately on the Spark side.

Every view is a projection / aggregate over whole tables: its size grows
with the scale factor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import tables

# "Now" of the fixture world: 2024-01-30 12:30:00 UTC. Operators never read
# the wall clock; they take this as a parameter.
NOW_MS = 1_706_617_800_000

# Model name served by engine k (k = user_id % 8), in order.
MODEL_NAMES = (
    "meta-llama/Llama-3.1-8B-Instruct",
    "Qwen/Qwen2.5-7B-Instruct",
    "mistralai/Mistral-7B-Instruct-v0.3",
    "google/gemma-2-9b-it",
    "deepseek-ai/DeepSeek-V3",
    "acme-labs/house-model-7b",
    "gpt-oss-20b",
    None,
)

# Histogram bucket bounds in seconds (``+Inf`` appended).
HIST_BOUNDS = (0.001, 0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0)
# Latency (ms) of each histogram metric as a multiple of events.value.
HIST_SCALE = (("ttft", 3.0), ("itl", 0.1), ("e2e", 7.0), ("tpot", 0.125))


@dataclass(frozen=True)
class Dialect:
    name: str  # "spark" | "duckdb"

    def ms(self, ts: str) -> str:
        if self.name == "duckdb":
            return f"(epoch_us({ts}) // 1000)"
        return (
            f"(cast(unix_date(to_date({ts})) as bigint) * 86400000"
            f" + cast(hour({ts}) as bigint) * 3600000"
            f" + cast(minute({ts}) as bigint) * 60000"
            f" + cast(floor(date_part('SECOND', {ts}) * 1000) as bigint))"
        )

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))" if self.name == "duckdb" else f"(({a}) div ({b}))"

    def t(self, table: str) -> str:
        return table if self.name == "duckdb" else "{" + table + "}"

    def inf(self) -> str:
        return "CAST('Infinity' AS DOUBLE)"

    def model_case(self, k: str) -> str:
        arms = " ".join(
            f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODEL_NAMES) if m is not None
        )
        return f"(CASE {k} {arms} ELSE NULL END)"


SPARK = Dialect("spark")
DUCK = Dialect("duckdb")


# --------------------------------------------------------------------------
# SQL texts
# --------------------------------------------------------------------------

def sql_snapshots_1s(d: Dialect) -> str:
    """Raw 1 s tier: one row per event; ``error`` events carry nulls."""
    ok = "event_type <> 'error'"
    return f"""
SELECT
  'engine-' || CAST(user_id % 8 AS STRING) AS engine_key,
  {d.ms('ts')} AS ts,
  CASE WHEN {ok} THEN CAST(floor(value * 10) AS BIGINT) END AS total_prompt_tokens,
  CASE WHEN {ok} THEN event_id % 50 END AS total_gen_tokens,
  event_id % 5 + 1 AS total_requests,
  CASE WHEN {ok} THEN value END AS prompt_tps,
  CASE WHEN {ok} THEN value / 2 END AS decode_tps,
  CASE WHEN {ok} THEN value * 3 END AS ttft_ms,
  CASE WHEN {ok} THEN value / 10 END AS itl_ms,
  CASE WHEN {ok} THEN value * 7 END AS e2e_ms,
  value + 100 AS power_watts,
  CAST(event_id % 101 AS DOUBLE) AS gpu_util,
  CAST(user_id % 50 + 40 AS DOUBLE) AS gpu_temp,
  event_id % 7 AS active_requests,
  CASE WHEN {ok} THEN user_id % 4 END AS queued_requests,
  CAST(event_id % 100 AS DOUBLE) AS kv_cache_pct,
  CAST(user_id % 10 AS DOUBLE) * 10 AS prefix_cache_hit,
  CAST(event_id % 97 AS DOUBLE) AS cpu_util,
  CASE WHEN {ok} THEN CAST(user_id % 90 AS DOUBLE) END AS mem_used_pct,
  event_id % 3 AS preemptions_total,
  CASE WHEN {ok} THEN value / 4 END AS queue_time_ms,
  CASE WHEN {ok} THEN value / 8 END AS tpot_ms
FROM {d.t('events')}
""".replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


def sql_engine_snapshots(d: Dialect) -> str:
    """One engine snapshot per (hour tick, engine); exact aggregates only."""
    tick = f"{d.div(d.ms('ts'), '3600000')} * 3600000"
    k = "user_id % 8"
    return f"""
SELECT tick_ts, engine_key, engine_type, endpoint, status_type, model_name,
  tokens_per_sec, avg_tokens_per_sec, prompt_tokens_per_sec, avg_prompt_tokens_per_sec,
  active_requests, queued_requests, total_requests, swapped_requests, preemptions_total,
  total_prompt_tokens, total_generation_tokens, prefix_cache_queries_total,
  spec_decode_draft_tokens_total, spec_decode_accepted_tokens_total, spec_decode_drafts_total,
  spec_decode_acceptance_rate_live,
  ttft_ms, e2e_latency_ms, queue_time_ms, inter_token_latency_ms, per_request_tps, per_request_prompt_tps,
  avg_batch_size, kv_cache_percent, prefix_cache_hit_rate,
  ttft_p50_ms, ttft_p95_ms, ttft_p99_ms, itl_p50_ms, itl_p95_ms, itl_p99_ms,
  e2e_p50_ms, e2e_p95_ms, e2e_p99_ms,
  ttft_goodput_pct, itl_goodput_pct, e2e_goodput_pct, n_events,
  tpot_ms, tpot_p50_ms, tpot_p95_ms, tpot_p99_ms, tpot_goodput_pct
FROM (
SELECT
  {tick} AS tick_ts,
  'engine-' || CAST({k} AS STRING) AS engine_key,
  'vllm' AS engine_type,
  'http://10.0.0.' || CAST({k} AS STRING) || ':' || CAST(8000 + {k} AS STRING) AS endpoint,
  CASE WHEN count_if(event_type = 'error') = count(*) THEN 'Error'
       WHEN 2 * count_if(event_type = 'error') > count(*) THEN 'Stopped'
       WHEN count_if(event_type = 'signup') = count(*) THEN 'Loading'
       ELSE 'Running' END AS status_type,
  {d.model_case(k)} AS model_name,
  max(value) AS tokens_per_sec,
  min(value) AS avg_tokens_per_sec,
  max(value) * 2 AS prompt_tokens_per_sec,
  min(value) * 2 AS avg_prompt_tokens_per_sec,
  max(event_id % 7) AS active_requests,
  CASE WHEN count_if(event_type = 'error') > 0 THEN NULL ELSE max(user_id % 4) END AS queued_requests,
  CAST(sum(event_id % 5 + 1) AS BIGINT) AS total_requests,
  min(event_id % 3) AS swapped_requests,
  CAST(sum(event_id % 3) AS BIGINT) AS preemptions_total,
  CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS total_prompt_tokens,
  CAST(sum(event_id % 50) AS BIGINT) AS total_generation_tokens,
  CAST(sum(user_id % 10) AS BIGINT) AS prefix_cache_queries_total,
  CASE WHEN {k} % 2 = 0 THEN CAST(sum(event_id % 40 + 20) AS BIGINT) END AS spec_decode_draft_tokens_total,
  CASE WHEN {k} % 2 = 0 THEN CAST(sum(event_id % 20) AS BIGINT) END AS spec_decode_accepted_tokens_total,
  CASE WHEN {k} % 2 = 0 THEN CAST(sum(event_id % 10 + 1) AS BIGINT) END AS spec_decode_drafts_total,
  CASE WHEN {k} % 2 = 0 THEN CAST(max(event_id % 100) AS DOUBLE) END AS spec_decode_acceptance_rate_live,
  CASE WHEN count_if(event_type = 'error') > 0 AND {k} % 3 = 0 THEN NULL ELSE max(value) * 3 END AS ttft_ms,
  max(value) * 7 AS e2e_latency_ms,
  min(value) / 4 AS queue_time_ms,
  min(value) / 10 AS inter_token_latency_ms,
  CASE WHEN count_if(event_type = 'error') > 0 THEN NULL ELSE max(value) / 5 END AS per_request_tps,
  max(value) / 3 AS per_request_prompt_tps,
  CAST(max(event_id % 16) AS DOUBLE) AS avg_batch_size,
  CAST(max(event_id % 100) AS DOUBLE) AS kv_cache_percent,
  CAST(min(user_id % 10) AS DOUBLE) * 10 AS prefix_cache_hit_rate,
  CASE WHEN {k} % 2 = 1 THEN min(value) * 3 END AS ttft_p50_ms,
  CASE WHEN {k} % 2 = 1 THEN max(value) * 3 END AS ttft_p95_ms,
  CASE WHEN {k} % 2 = 1 THEN max(value) * 3 + 1 END AS ttft_p99_ms,
  CASE WHEN {k} % 2 = 1 THEN min(value) / 10 END AS itl_p50_ms,
  CASE WHEN {k} % 2 = 1 THEN max(value) / 10 END AS itl_p95_ms,
  CASE WHEN {k} % 2 = 1 AND count_if(event_type = 'view') = 0 THEN max(value) / 10 + 1 END AS itl_p99_ms,
  CASE WHEN count_if(event_type = 'error') = 0 THEN min(value) / 8 END AS tpot_ms,
  CASE WHEN {k} % 3 = 1 THEN min(value) / 8 END AS tpot_p50_ms,
  CASE WHEN {k} % 3 = 1 THEN max(value) / 8 END AS tpot_p95_ms,
  CASE WHEN {k} % 3 = 1 AND count_if(event_type = 'view') = 0 THEN max(value) / 8 + 1 END AS tpot_p99_ms,
  CASE WHEN {k} % 3 = 1 THEN CAST(max(event_id % 90) AS DOUBLE) END AS tpot_goodput_pct,
  CASE WHEN {k} % 4 = 1 THEN min(value) * 7 END AS e2e_p50_ms,
  CASE WHEN {k} % 4 = 1 THEN max(value) * 7 END AS e2e_p95_ms,
  CASE WHEN {k} % 4 = 1 THEN max(value) * 7 + 1 END AS e2e_p99_ms,
  CAST(100 - max(event_id % 20) AS DOUBLE) AS ttft_goodput_pct,
  CASE WHEN {k} % 3 <> 2 THEN CAST(100 - max(event_id % 7) AS DOUBLE) END AS itl_goodput_pct,
  CAST(100 - max(user_id % 30) AS DOUBLE) AS e2e_goodput_pct,
  count(*) AS n_events
FROM {d.t('events')}
GROUP BY {tick}, {k}
) s
""".replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


def sql_engine_polls(d: Dialect) -> str:
    """One poll per event with cumulative counters that restart every week.

    A counter column is null on ``error`` polls (missing sample); the
    cumulative value itself keeps growing underneath.
    """
    week = d.div(d.ms("ts"), str(7 * 86_400_000))
    w = f"PARTITION BY user_id % 8, {week} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ok = "event_type <> 'error'"
    spec = "event_type <> 'signup'"
    return f"""
SELECT
  'engine-' || CAST(user_id % 8 AS STRING) AS engine_key,
  {d.ms('ts')} AS ts,
  event_id AS seq,
  event_type <> 'error' AS success,
  CASE WHEN {ok} THEN CAST(sum(CAST(floor(value * 10) AS BIGINT)) OVER ({w}) AS BIGINT) END AS prompt_tokens_total,
  CASE WHEN {ok} THEN CAST(sum(event_id % 50) OVER ({w}) AS BIGINT) END AS generation_tokens_total,
  CASE WHEN {ok} THEN CAST(sum(event_id % 5 + 1) OVER ({w}) AS BIGINT) END AS requests_total,
  CASE WHEN {spec} THEN CAST(sum(event_id % 20) OVER ({w}) AS DOUBLE) END AS spec_accepted_total,
  CASE WHEN {spec} THEN CAST(sum(event_id % 40 + 20) OVER ({w}) AS DOUBLE) END AS spec_draft_total,
  CASE WHEN {spec} THEN CAST(sum(event_id % 10 + 1) OVER ({w}) AS DOUBLE) END AS spec_drafts_total,
  CAST(sum(event_id % 4) OVER ({w}) AS DOUBLE) AS ttft_count_total,
  CAST(sum(value * 3) OVER ({w}) AS DOUBLE) AS ttft_sum_total,
  CASE WHEN {ok} THEN value * 3 END AS ttft_ms,
  value AS tokens_per_sec,
  CAST(event_id % 7 AS BIGINT) AS active_requests
FROM {d.t('events')}
""".replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


def sql_hist_buckets(d: Dialect) -> str:
    """Cumulative histogram per (engine, hour, metric): one row per bound.

    One aggregation pass computes every cumulative count at once
    (``count_if(lat <= bound)`` per bound, latency seconds = value * scale /
    1000); the per-histogram row is then unpivoted into one row per bound.
    """
    tick = f"{d.div(d.ms('ts'), '3600000')} * 3600000"
    bounds = [repr(b) for b in HIST_BOUNDS] + [d.inf()]
    metric_case = "CASE m " + " ".join(f"WHEN '{m}' THEN value * {s} / 1000" for m, s in HIST_SCALE) + " END"
    metrics = ", ".join(f"'{m}'" for m, _ in HIST_SCALE)
    counts = ", ".join(f"count_if(lat <= {b}) AS c{i}" for i, b in enumerate(bounds))
    gen = (f"CROSS JOIN (SELECT unnest([{metrics}]) AS m) ms" if d.name == "duckdb"
           else f"LATERAL VIEW explode(array({metrics})) ms AS m")
    head = f"""
WITH obs AS (
  SELECT 'engine-' || CAST(user_id % 8 AS STRING) AS engine_key, {tick} AS tick_ts, m AS metric, {metric_case} AS lat
  FROM {d.t('events')} {gen}
  WHERE event_type <> 'error'
),
agg AS (SELECT engine_key, tick_ts, metric, {counts} FROM obs GROUP BY engine_key, tick_ts, metric)
"""
    if d.name == "duckdb":
        body = " UNION ALL ".join(
            f"SELECT engine_key, tick_ts, metric, {b} AS le, CAST(c{i} AS DOUBLE) AS cum FROM agg" for i, b in enumerate(bounds))
    else:
        pairs = ", ".join(f"CAST({b} AS DOUBLE), CAST(c{i} AS DOUBLE)" for i, b in enumerate(bounds))
        body = f"SELECT engine_key, tick_ts, metric, stack({len(bounds)}, {pairs}) AS (le, cum) FROM agg"
    return (head + body).replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


def sql_hist_totals(d: Dialect) -> str:
    """Histogram _sum (seconds) and _count per (engine, hour, metric)."""
    tick = f"{d.div(d.ms('ts'), '3600000')} * 3600000"
    metrics = ", ".join(f"'{m}'" for m, _ in HIST_SCALE)
    us = "CASE m " + " ".join(f"WHEN '{m}' THEN floor(value * {s} * 1000)" for m, s in HIST_SCALE) + " END"
    gen = f"CROSS JOIN (SELECT unnest([{metrics}]) AS m) ms" if d.name == "duckdb" else f"LATERAL VIEW explode(array({metrics})) ms AS m"
    return f"""
SELECT engine_key, tick_ts, metric, CAST(sum_us AS DOUBLE) / 1000000.0 AS sum_s, CAST(cnt AS DOUBLE) AS count
FROM (SELECT 'engine-' || CAST(user_id % 8 AS STRING) AS engine_key, {tick} AS tick_ts, m AS metric, sum(CAST({us} AS BIGINT)) AS sum_us, count(*) AS cnt
      FROM {d.t('events')} {gen} WHERE event_type <> 'error' GROUP BY 1, 2, 3) u
""".replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


def sql_process_tree(d: Dialect) -> str:
    """Process table from ``part``: pid = p_partkey, parent = p_partkey div 4 (pid 0 is its own parent)."""
    return f"SELECT p_partkey AS pid, {d.div('p_partkey', '4')} AS parent FROM {d.t('part')}"


def sql_gpu_procs(d: Dialect) -> str:
    """Per-GPU process list entries from ``lineitem`` x ``part``: device = p_size % 8."""
    return (
        f"SELECT DISTINCT p.p_size % 8 AS gpu_index, l.l_partkey AS pid "
        f"FROM {d.t('lineitem')} l JOIN {d.t('part')} p ON l.l_partkey = p.p_partkey"
    )


def sql_engine_pids(d: Dialect) -> str:
    """Engine -> PIDs from ``lineitem``: engine = 'sup-' || l_suppkey, pid = l_partkey."""
    return (
        f"SELECT DISTINCT 'sup-' || CAST(l_suppkey AS STRING) AS engine_key, l_partkey AS pid "
        f"FROM {d.t('lineitem')}"
    ).replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


def sql_probes(d: Dialect) -> str:
    """Health probes: one per event, keyed by user; success unless ``error``."""
    return (
        f"SELECT 'probe-' || CAST(user_id AS STRING) AS engine_key, {d.ms('ts')} AS ts, event_id AS seq, "
        f"event_type <> 'error' AS success, event_type AS status_type FROM {d.t('events')}"
    ).replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

_VIEWS = {
    "snapshots_1s": (sql_snapshots_1s, ("events",)),
    "engine_snapshots": (sql_engine_snapshots, ("events",)),
    "engine_polls": (sql_engine_polls, ("events",)),
    "hist_buckets": (sql_hist_buckets, ("events",)),
    "hist_totals": (sql_hist_totals, ("events",)),
    "process_tree": (sql_process_tree, ("part",)),
    "gpu_procs": (sql_gpu_procs, ("lineitem", "part")),
    "engine_pids": (sql_engine_pids, ("lineitem",)),
    "probes": (sql_probes, ("events",)),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a Spark DataFrame (lazy; no temp view registered)."""
    fn, srcs = _VIEWS[name]
    dfs = {t: tables.read(spark, sf_dir, t) for t in srcs}
    return spark.sql(fn(SPARK), **dfs)


def duck_cte(*names: str) -> str:
    """``WITH`` clause defining the named fixture views for the DuckDB oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n][0](DUCK)})" for n in names) + "\n"


def snapshots_1s(spark, sf_dir):
    return view(spark, sf_dir, "snapshots_1s")


def engine_snapshots(spark, sf_dir):
    return view(spark, sf_dir, "engine_snapshots")
