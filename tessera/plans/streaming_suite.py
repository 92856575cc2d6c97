"""Registered queries: streaming rollup end to end, conflation and tick dedupe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeutil import DAY_MS
from ..operators import settings as SE
from ..operators import tiers as T
from ..session import scratch_dir
from ..sources import fixtures as fx
from ..sources import tier_store as TS
from ..streaming import jobs as SJ
from . import maintenance_suite
from . import world as W
from .registry import query


# Arrival of the fixture's raw rows: every fourth kind of row is 90 minutes late. Slices of arrival come one after the other.
LATE_MS = 90 * 60_000
SLICES = (W.NOW_MS - 22 * DAY_MS, W.NOW_MS - 11 * DAY_MS)


def slices(raw):
    """The raw rows by arrival, as so many feeds."""
    arrival = F.col("ts") + F.when(F.col("total_requests") == 4, F.lit(LATE_MS)).otherwise(F.lit(0))
    edges = [-(2**62), *SLICES, 2**62]
    return [raw.where((arrival >= a) & (arrival < b)) for a, b in zip(edges, edges[1:])]


@query("stream_rollup", W.tier_cte() + "SELECT 'hour' AS tier, * FROM hourly_all UNION ALL SELECT 'day', * FROM snapshots_1d")
def q_stream_rollup(spark, sf):
    """Each slice of the feed goes through both queries, which go on from their checkpoints; hours and days that are over by now."""
    base = scratch_dir(spark, "stream-rollup")
    raw = W.raw(spark, sf)
    raw.limit(0).write.parquet(f"{base}/feed")  # the folder that the stream follows
    stream = spark.readStream.schema(raw.schema).parquet(f"{base}/feed")
    for rows in slices(raw):
        rows.write.mode("append").parquet(f"{base}/feed")
        for q in SJ.stream_rollup(spark, stream, base, f"{base}/checkpoint"):
            q.awaitTermination()
    hour, day = (TS.read(spark, base, t).select(F.lit(t).alias("tier"), *T.TIER_COLUMNS) for t in ("hour", "day"))
    return hour.where(F.col("bucket_ts") < W.HOUR_CUT).unionByName(day.where(F.col("bucket_ts") < W.DAY_CUT))


def _gate_sql() -> str:
    edges = [-(2**62), *SLICES, 2**62]
    log = maintenance_suite._settings_log_sql(fx.DUCK)
    arms = " UNION ALL ".join(
        f"SELECT * FROM snapshots_1s WHERE ts + CASE WHEN total_requests = 4 THEN {LATE_MS} ELSE 0 END >= {a} AND ts + CASE WHEN total_requests = 4 THEN {LATE_MS} ELSE 0 END < {b} "
        f"AND coalesce((SELECT arg_max(value, (updated_at, value)) FROM ({log}) l WHERE key = 'enabled' AND updated_at < {b} AND updated_at % 3 = {k}), 'true') = 'true'"
        for k, (a, b) in enumerate(zip(edges, edges[1:])))
    return W.tier_cte() + f"SELECT *, (ts // 86400000) * 86400000 AS day FROM ({arms}) x"


@query("raw_append", _gate_sql())
def q_raw_append(spark, sf):
    """Each slice is appended if the settings written up to its end (a third of the log each) leave recording on."""
    base = scratch_dir(spark, "raw-append")
    raw = W.raw(spark, sf)
    log = maintenance_suite.settings_log(spark, sf)
    raw.limit(0).write.parquet(f"{base}/feed")  # the folder that the stream follows
    stream = spark.readStream.schema(raw.schema).parquet(f"{base}/feed")
    for k, (rows, until) in enumerate(zip(slices(raw), [*SLICES, 2**62])):
        rows.write.mode("append").parquet(f"{base}/feed")
        current = SE.settings_view(SE.settings_upsert(log.where((F.col("updated_at") < until) & (F.col("updated_at") % 3 == k))))
        SJ.raw_append(stream, f"{base}/raw", f"{base}/checkpoint", current).awaitTermination()
    return spark.read.schema(raw.schema.add("day", "long")).parquet(f"{base}/raw")


@query("conflate_latest", W.tier_cte() + """
SELECT * FROM snapshots_1s
QUALIFY row_number() OVER (PARTITION BY engine_key, ts // 2000 ORDER BY ts DESC, total_requests DESC, power_watts DESC) = 1
UNION
SELECT * FROM snapshots_1s QUALIFY row_number() OVER (PARTITION BY engine_key ORDER BY ts, total_requests, power_watts) = 1
""")
def q_conflate_latest(spark, sf):
    return SJ.conflate_latest(W.raw(spark, sf), "engine_key", "ts", ties=("total_requests", "power_watts"))


@query("tick_dedupe", W.tier_cte() + """
SELECT engine_key, ts_s AS ts, power_watts FROM (
  SELECT engine_key, (ts // 1000) * 1000 AS ts_s, power_watts,
    lag((ts // 1000) * 1000) OVER (PARTITION BY engine_key ORDER BY (ts // 1000) * 1000, power_watts) AS p FROM snapshots_1s) x
WHERE p IS NULL OR ts_s <> p
""")
def q_tick_dedupe(spark, sf):
    r = W.raw(spark, sf).select("engine_key", (F.col("ts") - F.col("ts") % 1000).alias("ts"), "power_watts")
    return SJ.tick_dedupe(r, "engine_key", "ts", "power_watts")
