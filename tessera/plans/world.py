"""The fixture world shared by registered queries: tiers as of ``NOW_MS``.

Spark side writes the tiers once as stored tables and reads them from there;
the oracle side has an independent SQL text for each tier (``tier_cte``).
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import DAY_MS, HOUR_MS
from ..operators import tiers
from ..session import scratch_dir
from ..sources import fixtures as fx
from ..sources import tier_store

NOW_MS = fx.NOW_MS
HOUR_CUT = (NOW_MS // HOUR_MS) * HOUR_MS
DAY_CUT = (NOW_MS // DAY_MS) * DAY_MS
RETAIN_CUT = NOW_MS - 30 * DAY_MS


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return fx.view(spark, sf, "snapshots_1s")


_stores: dict[tuple[str, str], str] = {}
_lock = threading.Lock()


def store(spark: SparkSession, sf: str) -> str:
    """The folder of the stored tiers of ``sf``, made once per application: raw, its hours, their days."""
    with _lock:
        key = spark.sparkContext.applicationId, sf
        folder = _stores.get(key)
        if folder is None or not tier_store.exists(spark, f"{folder}/ready"):
            folder = scratch_dir(spark, "tiers")
            tier_store.write(raw(spark, sf), folder, "raw")
            tier_store.write(tiers.rollup_1h(tier_store.read(spark, folder, "raw"), NOW_MS), folder, "hour")
            tier_store.write(tiers.rollup_1d(tier_store.read(spark, folder, "hour"), NOW_MS), folder, "day")
            spark.range(0).write.parquet(f"{folder}/ready")
            _stores[key] = folder
    return folder


def stored(spark: SparkSession, sf: str, tier: str) -> DataFrame:
    return tier_store.read(spark, store(spark, sf), tier)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.hourly_retained(stored(spark, sf, "hour"), NOW_MS).where(F.col("day") >= RETAIN_CUT // DAY_MS).drop("day")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "day").drop("day")


def raw_remainder(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.raw_remainder(stored(spark, sf, "raw"), NOW_MS).where(F.col("day") >= HOUR_CUT // DAY_MS).drop("day")


# ---------------------------------------------------------------- oracle SQL

HOURLY_SQL = f"""
SELECT engine_key, (ts // 3600000) * 3600000 AS bucket_ts,
  CAST(SUM(COALESCE(total_prompt_tokens, 0)) AS BIGINT) AS total_prompt_tokens,
  CAST(SUM(COALESCE(total_gen_tokens, 0)) AS BIGINT) AS total_gen_tokens,
  CAST(SUM(COALESCE(total_requests, 0)) AS BIGINT) AS total_requests,
  AVG(prompt_tps) AS prompt_tps_avg, MAX(prompt_tps) AS prompt_tps_max,
  AVG(decode_tps) AS decode_tps_avg, MAX(decode_tps) AS decode_tps_max,
  AVG(ttft_ms) AS ttft_ms_p95, AVG(itl_ms) AS itl_ms_p95, AVG(e2e_ms) AS e2e_ms_p95,
  SUM(power_watts) AS power_watts_sum,
  AVG(gpu_util) AS gpu_util_avg, AVG(gpu_temp) AS gpu_temp_avg, MAX(gpu_temp) AS gpu_temp_max,
  MAX(active_requests) AS active_requests_max, MAX(queued_requests) AS queued_requests_max,
  AVG(kv_cache_pct) AS kv_cache_pct_avg, MAX(kv_cache_pct) AS kv_cache_pct_max,
  AVG(prefix_cache_hit) AS prefix_cache_hit_avg, AVG(cpu_util) AS cpu_util_avg,
  COUNT(*) AS sample_count, MAX(preemptions_total) AS preemptions_total,
  AVG(queue_time_ms) AS queue_time_ms_avg, AVG(tpot_ms) AS tpot_ms_avg
FROM snapshots_1s WHERE ts < {HOUR_CUT}
GROUP BY engine_key, ts // 3600000
"""

DAILY_SQL = f"""
SELECT engine_key, (bucket_ts // 86400000) * 86400000 AS bucket_ts,
  CAST(SUM(COALESCE(total_prompt_tokens, 0)) AS BIGINT) AS total_prompt_tokens,
  CAST(SUM(COALESCE(total_gen_tokens, 0)) AS BIGINT) AS total_gen_tokens,
  CAST(SUM(COALESCE(total_requests, 0)) AS BIGINT) AS total_requests,
  AVG(prompt_tps_avg) AS prompt_tps_avg, MAX(prompt_tps_max) AS prompt_tps_max,
  AVG(decode_tps_avg) AS decode_tps_avg, MAX(decode_tps_max) AS decode_tps_max,
  AVG(ttft_ms_p95) AS ttft_ms_p95, AVG(itl_ms_p95) AS itl_ms_p95, AVG(e2e_ms_p95) AS e2e_ms_p95,
  SUM(power_watts_sum) AS power_watts_sum,
  AVG(gpu_util_avg) AS gpu_util_avg, AVG(gpu_temp_avg) AS gpu_temp_avg, MAX(gpu_temp_max) AS gpu_temp_max,
  MAX(active_requests_max) AS active_requests_max, MAX(queued_requests_max) AS queued_requests_max,
  AVG(kv_cache_pct_avg) AS kv_cache_pct_avg, MAX(kv_cache_pct_max) AS kv_cache_pct_max,
  AVG(prefix_cache_hit_avg) AS prefix_cache_hit_avg, AVG(cpu_util_avg) AS cpu_util_avg,
  CAST(SUM(sample_count) AS BIGINT) AS sample_count, MAX(preemptions_total) AS preemptions_total,
  AVG(queue_time_ms_avg) AS queue_time_ms_avg, AVG(tpot_ms_avg) AS tpot_ms_avg
FROM hourly_all WHERE bucket_ts < {DAY_CUT}
GROUP BY engine_key, bucket_ts // 86400000
"""


def tier_cte(*extra: str) -> str:
    """WITH clause: snapshots_1s, hourly_all, snapshots_1h, snapshots_1d, raw_rest (+ extra fixtures)."""
    base = fx.duck_cte("snapshots_1s", *extra)
    return (
        base.rstrip("\n")
        + f""",
hourly_all AS ({HOURLY_SQL}),
snapshots_1h AS (SELECT * FROM hourly_all WHERE bucket_ts >= {RETAIN_CUT}),
snapshots_1d AS ({DAILY_SQL}),
raw_rest AS (SELECT * FROM snapshots_1s WHERE ts >= {HOUR_CUT})
"""
    )
