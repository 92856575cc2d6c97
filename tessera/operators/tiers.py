"""Three-tier time-series store: 1 s raw -> 1 h -> 1 d.

Rollups are plain ``groupBy`` aggregations on (engine_key, epoch-aligned
bucket); Spark's partial/final hash aggregation pre-aggregates map side, so
a hot engine key costs one partial row per input partition, not a hot task.
Tier tables are parquet partitioned by a ``bucket_date``-style column so an
upsert rewrites only the touched partitions (dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import DAY_MS, HOUR_MS, bucket

RAW_COLUMNS = [
    "engine_key", "ts",
    "total_prompt_tokens", "total_gen_tokens", "total_requests",
    "prompt_tps", "decode_tps", "ttft_ms", "itl_ms", "e2e_ms",
    "power_watts", "gpu_util", "gpu_temp",
    "active_requests", "queued_requests",
    "kv_cache_pct", "prefix_cache_hit", "cpu_util", "mem_used_pct",
    "preemptions_total", "queue_time_ms", "tpot_ms",
]

TIER_COLUMNS = [
    "engine_key", "bucket_ts",
    "total_prompt_tokens", "total_gen_tokens", "total_requests",
    "prompt_tps_avg", "prompt_tps_max", "decode_tps_avg", "decode_tps_max",
    "ttft_ms_p95", "itl_ms_p95", "e2e_ms_p95",
    "power_watts_sum", "gpu_util_avg", "gpu_temp_avg", "gpu_temp_max",
    "active_requests_max", "queued_requests_max",
    "kv_cache_pct_avg", "kv_cache_pct_max", "prefix_cache_hit_avg", "cpu_util_avg",
    "sample_count", "preemptions_total", "queue_time_ms_avg", "tpot_ms_avg",
]


def _sum0(c: str) -> Column:
    return F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint")


def hour_aggs() -> list[Column]:
    # Latency columns keep their *_p95 names although they hold averages.
    return [
        _sum0("total_prompt_tokens").alias("total_prompt_tokens"),
        _sum0("total_gen_tokens").alias("total_gen_tokens"),
        _sum0("total_requests").alias("total_requests"),
        F.avg("prompt_tps").alias("prompt_tps_avg"),
        F.max("prompt_tps").alias("prompt_tps_max"),
        F.avg("decode_tps").alias("decode_tps_avg"),
        F.max("decode_tps").alias("decode_tps_max"),
        F.avg("ttft_ms").alias("ttft_ms_p95"),
        F.avg("itl_ms").alias("itl_ms_p95"),
        F.avg("e2e_ms").alias("e2e_ms_p95"),
        F.sum("power_watts").alias("power_watts_sum"),
        F.avg("gpu_util").alias("gpu_util_avg"),
        F.avg("gpu_temp").alias("gpu_temp_avg"),
        F.max("gpu_temp").alias("gpu_temp_max"),
        F.max("active_requests").alias("active_requests_max"),
        F.max("queued_requests").alias("queued_requests_max"),
        F.avg("kv_cache_pct").alias("kv_cache_pct_avg"),
        F.max("kv_cache_pct").alias("kv_cache_pct_max"),
        F.avg("prefix_cache_hit").alias("prefix_cache_hit_avg"),
        F.avg("cpu_util").alias("cpu_util_avg"),
        F.count(F.lit(1)).alias("sample_count"),
        F.max("preemptions_total").alias("preemptions_total"),
        F.avg("queue_time_ms").alias("queue_time_ms_avg"),
        F.avg("tpot_ms").alias("tpot_ms_avg"),
    ]


def day_aggs() -> list[Column]:
    # Daily averages are unweighted means of hourly averages (parity).
    return [
        _sum0("total_prompt_tokens").alias("total_prompt_tokens"),
        _sum0("total_gen_tokens").alias("total_gen_tokens"),
        _sum0("total_requests").alias("total_requests"),
        F.avg("prompt_tps_avg").alias("prompt_tps_avg"),
        F.max("prompt_tps_max").alias("prompt_tps_max"),
        F.avg("decode_tps_avg").alias("decode_tps_avg"),
        F.max("decode_tps_max").alias("decode_tps_max"),
        F.avg("ttft_ms_p95").alias("ttft_ms_p95"),
        F.avg("itl_ms_p95").alias("itl_ms_p95"),
        F.avg("e2e_ms_p95").alias("e2e_ms_p95"),
        F.sum("power_watts_sum").alias("power_watts_sum"),
        F.avg("gpu_util_avg").alias("gpu_util_avg"),
        F.avg("gpu_temp_avg").alias("gpu_temp_avg"),
        F.max("gpu_temp_max").alias("gpu_temp_max"),
        F.max("active_requests_max").alias("active_requests_max"),
        F.max("queued_requests_max").alias("queued_requests_max"),
        F.avg("kv_cache_pct_avg").alias("kv_cache_pct_avg"),
        F.max("kv_cache_pct_max").alias("kv_cache_pct_max"),
        F.avg("prefix_cache_hit_avg").alias("prefix_cache_hit_avg"),
        F.avg("cpu_util_avg").alias("cpu_util_avg"),
        F.sum("sample_count").cast("bigint").alias("sample_count"),
        F.max("preemptions_total").alias("preemptions_total"),
        F.avg("queue_time_ms_avg").alias("queue_time_ms_avg"),
        F.avg("tpot_ms_avg").alias("tpot_ms_avg"),
    ]


def rollup_1h(raw: DataFrame, now_ms: int) -> DataFrame:
    """Raw -> hourly buckets per engine, completed hours only (``ts < hour(now)``)."""
    cutoff = (now_ms // HOUR_MS) * HOUR_MS
    return (
        raw.where(F.col("ts") < F.lit(cutoff))
        .groupBy("engine_key", bucket(F.col("ts"), HOUR_MS).alias("bucket_ts"))
        .agg(*hour_aggs())
        .select(*TIER_COLUMNS)
    )


def rollup_1d(hourly: DataFrame, now_ms: int) -> DataFrame:
    """Hourly -> daily buckets per engine, completed days only."""
    cutoff = (now_ms // DAY_MS) * DAY_MS
    return (
        hourly.where(F.col("bucket_ts") < F.lit(cutoff))
        .groupBy("engine_key", bucket(F.col("bucket_ts"), DAY_MS).alias("bucket_ts"))
        .agg(*day_aggs())
        .select(*TIER_COLUMNS)
    )


def raw_remainder(raw: DataFrame, now_ms: int) -> DataFrame:
    """Raw rows not yet rolled up: the reference prunes raw below the hour cutoff."""
    return raw.where(F.col("ts") >= F.lit((now_ms // HOUR_MS) * HOUR_MS))


def hourly_retained(hourly: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Hourly rows kept after the 30-day retention (``bucket_ts >= now - 30 d``)."""
    return hourly.where(F.col("bucket_ts") >= F.lit(now_ms - days * DAY_MS))


def upsert_replace(existing: DataFrame, updates: DataFrame, keys=("engine_key", "bucket_ts")) -> DataFrame:
    """Insert-or-replace all columns on ``keys``: updated rows win, others stay.

    One shuffle on the keys (the anti join); written back with dynamic
    partition overwrite so only touched partitions are rewritten.
    """
    keep = existing.join(updates.select(*keys), list(keys), "left_anti")
    return keep.unionByName(updates.select(*existing.columns))


def retention_prune_counts(raw: DataFrame, hourly: DataFrame, daily: DataFrame, older_than_ms: int) -> DataFrame:
    """Rows a prune would delete per tier (strict ``<``), as one row (n1s, n1h, n1d)."""
    t = F.lit(older_than_ms)
    a = raw.agg(F.count_if(F.col("ts") < t).alias("n1s"))
    b = hourly.agg(F.count_if(F.col("bucket_ts") < t).alias("n1h"))
    c = daily.agg(F.count_if(F.col("bucket_ts") < t).alias("n1d"))
    return a.crossJoin(b).crossJoin(c)  # three one-row aggregates


def retention_prune(df: DataFrame, ts_col: str, older_than_ms: int) -> DataFrame:
    """Rows that survive the prune (``ts >= T``)."""
    return df.where(F.col(ts_col) >= F.lit(older_than_ms))


PURGE_LIMIT = 10_000_000_000_000  # fixed value: 10^13 tokens


def purge_cumulative(df: DataFrame) -> DataFrame:
    """Drop rows whose token count looks cumulative (> 10^13); null counts as 0."""
    return df.where(F.coalesce(F.col("total_prompt_tokens"), F.lit(0)) <= F.lit(PURGE_LIMIT))


def power_backfill(df: DataFrame, markers: DataFrame, marker_key: str, factor: float = 4.0,
                   column: str = "power_watts") -> DataFrame:
    """Multiply ``column`` by ``factor`` unless ``markers`` already holds ``marker_key``.

    The gate is a one-row aggregate over the marker table cross joined to the
    data (a scalar, not a data cross join), so reruns are no-ops.
    """
    done = markers.agg(F.count_if(F.col("key") == F.lit(marker_key)).alias("_done"))
    out = df.crossJoin(done)
    return out.withColumn(
        column, F.when(F.col("_done") > 0, F.col(column)).otherwise(F.col(column) * F.lit(factor))
    ).drop("_done")


def schema_evolve(old: DataFrame, target_columns: list[tuple[str, str]]) -> DataFrame:
    """Add missing columns as typed nulls, keep column order of the target."""
    have = set(old.columns)
    cols = [F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in target_columns]
    return old.select(*cols)
