"""Registered queries: throttle events, power limits, severity bands and event classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hardware as HW
from ..sources import fixtures as fx
from ..sources import tables
from . import world as W
from .registry import query


def _readings_sql(d) -> str:
    s = (f"SELECT 'host-' || CAST(l_suppkey % 10 AS STRING) AS host, {d.ms('l_shipdate')} AS ts, l_orderkey, "
         f"CAST(l_linenumber - 1 AS INT) AS gpu_index, CAST(l_orderkey % 256 AS INT) AS throttle_mask, "
         f"CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN 0 ELSE l_partkey * 10 END AS pml_mw, "
         f"CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 250000 END AS enforced_mw, "
         f"CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE 300000 END AS default_mw, 350000 AS constraint_mw "
         f"FROM {d.t('lineitem')}")
    return s.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


def readings(spark, sf):
    li = tables.read(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    return spark.sql(_readings_sql(fx.SPARK), lineitem=li)


_EVENTS = f"""
WITH r AS ({_readings_sql(fx.DUCK)}),
e AS (
  SELECT host, ts, l_orderkey, gpu_index, 0 AS ord, 'thermal' AS event_type, 'Thermal throttling active' AS detail FROM r WHERE (throttle_mask & 64) <> 0 OR (throttle_mask & 32) <> 0
  UNION ALL SELECT host, ts, l_orderkey, gpu_index, 1, 'throttle', 'Hardware slowdown engaged' FROM r WHERE (throttle_mask & 8) <> 0
  UNION ALL SELECT host, ts, l_orderkey, gpu_index, 2, 'power_brake', 'Power brake engaged' FROM r WHERE (throttle_mask & 128) <> 0
  UNION ALL SELECT host, ts, l_orderkey, gpu_index, 3, 'throttle', 'Software power cap limiting clocks' FROM r WHERE (throttle_mask & 4) <> 0
)
"""


def events(spark, sf):
    r = readings(spark, sf).select("host", "ts", "l_orderkey", "gpu_index", "throttle_mask")
    return HW.throttle_events(r)


@query("throttle_events", _EVENTS + "SELECT * FROM e")
def q_throttle_events(spark, sf):
    return events(spark, sf)


@query("event_severity", _EVENTS + "SELECT host, ts, l_orderkey, gpu_index, ord, CASE WHEN event_type IN ('thermal', 'xid') THEN 'critical' ELSE 'warning' END AS severity FROM e")
def q_event_severity(spark, sf):
    return events(spark, sf).select("host", "ts", "l_orderkey", "gpu_index", "ord", HW.event_severity(F.col("event_type")).alias("severity"))


@query("event_split", _EVENTS + """
SELECT host, gpu_index, count(*) FILTER (WHERE event_type = 'thermal') AS thermal_events,
  count(*) FILTER (WHERE event_type IN ('throttle', 'power_brake')) AS throttle_events FROM e GROUP BY 1, 2
""")
def q_event_split(spark, sf):
    g = events(spark, sf).withColumn("_g", HW.event_group(F.col("event_type")))
    return g.groupBy("host", "gpu_index").agg(F.count_if(F.col("_g") == "thermal").alias("thermal_events"),
                                              F.count_if(F.col("_g") == "throttle").alias("throttle_events"))


@query("power_limit", f"""
WITH r AS ({_readings_sql(fx.DUCK)})
SELECT host, ts, l_orderkey, gpu_index,
  CASE WHEN COALESCE(pml_mw, enforced_mw, default_mw, constraint_mw) > 0
       THEN COALESCE(pml_mw, enforced_mw, default_mw, constraint_mw) / 1000.0 END AS power_limit_watts
FROM r
""")
def q_power_limit(spark, sf):
    r = readings(spark, sf)
    return r.select("host", "ts", "l_orderkey", "gpu_index",
                    HW.power_limit_watts(F.col("pml_mw"), F.col("enforced_mw"), F.col("default_mw"), F.col("constraint_mw")).alias("power_limit_watts"))


_BAND_METRICS = ("gpu_temp", "cpu_util", "mem_used_pct", "kv_cache_pct")


@query("severity_bands", W.tier_cte() + """
, t AS (SELECT * FROM (VALUES """ + ", ".join(f"('{m}', {w}, {c})" for m, w, c in HW.THRESHOLDS) + """) t(metric, warning, critical)),
u AS (""" + " UNION ALL ".join(f"SELECT engine_key, ts, '{m}' AS metric, {m} AS value FROM snapshots_1s WHERE {m} IS NOT NULL" for m in _BAND_METRICS) + """)
SELECT u.metric, engine_key, ts, value,
  CASE WHEN value >= critical THEN 'critical' WHEN value >= warning THEN 'warning' ELSE 'healthy' END AS band
FROM u JOIN t USING (metric)
""")
def q_severity_bands(spark, sf):
    raw = W.raw(spark, sf)
    arms = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in _BAND_METRICS]
    u = raw.select("engine_key", "ts", F.explode(F.array(*arms)).alias("_r")).select("engine_key", "ts", "_r.metric", "_r.value")
    return HW.severity_bands(spark, u.where(F.col("value").isNotNull()))
