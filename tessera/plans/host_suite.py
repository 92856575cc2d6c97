"""Registered queries: host snapshots -- GPU choice, memory, disks, NICs, CPU, power, severity variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hardware as HW
from ..operators.windows import TRAILING, sliding_max
from ..sources import fixtures as fx
from ..sources import tables
from .registry import query

GIB = 1 << 30


def _s(sql: str, d) -> str:
    return sql.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


def gpus_sql(d) -> str:
    return _s(f"""SELECT l_orderkey AS snap_id, 'host-' || CAST(l_orderkey % 10 AS STRING) AS host,
  CAST(1704067200000 + l_orderkey * 1000 AS BIGINT) AS ts,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS INT) AS gpu_index,
  CASE l_partkey % 6 WHEN 0 THEN 'NVIDIA GB10' WHEN 1 THEN 'NVIDIA H100 80GB HBM3' WHEN 2 THEN 'NVIDIA GH200 480GB'
       WHEN 3 THEN 'NVIDIA A100-SXM4-40GB' WHEN 4 THEN 'Jetson AGX Orin' ELSE NULL END AS name,
  CAST(CAST(floor(l_quantity) AS BIGINT) * 2 % 101 AS INT) AS utilization_percent,
  CAST(30 + l_partkey % 70 AS INT) AS temperature_celsius,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice / 100.0 END AS power_watts,
  CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE 700.0 END AS power_limit_watts,
  CASE WHEN l_partkey % 6 = 5 THEN NULL ELSE CAST(85899345920 AS BIGINT) END AS memory_total_bytes,
  CAST(l_partkey AS BIGINT) * 1048576 AS memory_used_bytes,
  CASE WHEN l_partkey % 6 = 4 THEN NULL ELSE CAST(900 + l_suppkey % 1100 AS INT) END AS clock_graphics_mhz
FROM {d.t('lineitem')}""", d)


def memory_sql(d) -> str:
    total = f"(CAST(16 + (o_custkey % 8) * 16 AS BIGINT) * {GIB} - CAST(o_orderkey % 3000 AS BIGINT) * 1048576)"
    return f"""SELECT o_orderkey AS snap_id, {total} AS total_bytes,
  {d.div(total, '10')} * (o_orderkey % 10) AS available_bytes,
  {d.div(total, '10')} * (o_custkey % 7) AS cached_bytes,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 5 AS BIGINT) * {GIB} END AS gpu_estimated_bytes
FROM {d.t('orders')}"""


def disks_sql(d) -> str:
    return _s(f"""SELECT l_orderkey AS snap_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS INT) AS ord,
  CASE WHEN l_linenumber = 2 THEN '' ELSE 'nvme' || CAST(l_linenumber AS STRING) || 'n1' END AS name,
  CAST(l_partkey % 4 AS BIGINT) * 1000000000000 AS total_space,
  CAST(l_partkey AS BIGINT) * 1000 AS read_bytes, CAST(l_suppkey AS BIGINT) * 1000 AS write_bytes
FROM {d.t('lineitem')}""", d)


_NIC_NAMES = ("eth0", "lo", "docker0", "enp3s0", "veth12ab", "wlan0", "tailscale0", "br-1234")
_NIC_ADDRS = ("10.0.0.5", "127.0.0.1", "0.0.0.0", "169.254.1.5", "::1", "fe80::1", "2001:db8::1", "::")


def nics_sql(d) -> str:
    n = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_NIC_NAMES))
    a = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_NIC_ADDRS))
    return f"""SELECT l_orderkey AS snap_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS INT) AS ord, CASE l_partkey % 8 {n} END AS name,
  CASE l_suppkey % 8 {a} END AS address, CAST(l_partkey AS BIGINT) * 100 AS rx, CAST(l_suppkey AS BIGINT) * 100 AS tx
FROM {d.t('lineitem')}"""


def cores_sql(d) -> str:
    return f"""SELECT l_orderkey AS snap_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS INT) AS core_id, l_discount * 1000 AS usage_percent,
  CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE 'AMD EPYC 9654' END AS brand
FROM {d.t('lineitem')}"""


def nodes_sql(d) -> str:
    return _s(f"""SELECT l_orderkey AS snap_id, 'node-' || CAST(l_linenumber AS STRING) AS node, l_linestatus = 'O' AS online,
  CASE WHEN l_tax > 0.04 THEN l_extendedprice / 200.0 END AS primary_power
FROM {d.t('lineitem')}""", d)


def procs_sql(d) -> str:
    return f"""SELECT l_orderkey % 1000 AS snap_id, CAST(l_linenumber - 1 AS INT) AS gpu_index,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_partkey AS BIGINT) * 1048576 END AS used_bytes,
  (l_orderkey % 1000) % 7 <> 0 AS supported
FROM {d.t('lineitem')}"""


def _li(spark, sf):
    return tables.read(spark, sf, "lineitem")


def gpus(spark, sf):
    return spark.sql(gpus_sql(fx.SPARK), lineitem=_li(spark, sf))


def gpu_lists(spark, sf):
    return HW.gpu_array(gpus(spark, sf), ["snap_id", "host", "ts"])


D = fx.DUCK
GP = f"WITH g AS ({gpus_sql(D)})\n"

# ---------------------------------------------------------------- GPU choice


@query("gpu_select", GP + """
SELECT snap_id, CAST(count_if(gpu_index = 2) AS BIGINT) AS n_selected, max(CASE WHEN gpu_index = 2 THEN utilization_percent END) AS selected_util,
  count(*) AS n_all FROM g GROUP BY snap_id
""")
def q_gpu_select(spark, sf):
    g = gpu_lists(spark, sf)
    sel = HW.gpu_select(F.col("gpus"), 2)
    return g.select("snap_id", F.size(sel).cast("bigint").alias("n_selected"),
                    F.try_element_at(sel, F.lit(1))["utilization_percent"].alias("selected_util"),
                    F.size(HW.gpu_select(F.col("gpus"), None)).cast("bigint").alias("n_all"))


@query("primary_gpu", GP + """
, f AS (SELECT snap_id, arg_min({'i': gpu_index, 'n': name, 'w': power_watts}, gpu_index) AS p, count(*) AS n FROM g GROUP BY snap_id)
SELECT snap_id, p.i AS gpu_index, p.n AS name, CASE WHEN snap_id % 11 < 2 THEN p.w / 2 ELSE p.w END AS power_watts,
  CASE WHEN snap_id % 11 > 1 THEN p.i END AS listed_index, CASE WHEN snap_id % 11 < 2 THEN 1 ELSE n END AS n_shown FROM f
""")
def q_primary_gpu(spark, sf):
    """The first GPU of each snapshot. Some snapshots have an empty list and some none; readers then take the single GPU."""
    g = gpu_lists(spark, sf)
    first = F.try_element_at("gpus", F.lit(1))
    given = F.when(F.col("snap_id") % 11 == 0, F.filter("gpus", lambda x: F.lit(False))).when(F.col("snap_id") % 11 > 1, F.col("gpus"))
    g = g.select("snap_id", given.alias("gpus"), first.withField("power_watts", first["power_watts"] / 2).alias("gpu"))
    shown = HW.gpus_or_single(F.col("gpus"), F.col("gpu"))
    p = HW.primary_gpu(shown)
    return g.select("snap_id", p["gpu_index"].alias("gpu_index"), p["name"].alias("name"), p["power_watts"].alias("power_watts"),
                    HW.primary_gpu(F.col("gpus"))["gpu_index"].alias("listed_index"), F.size(shown).cast("bigint").alias("n_shown"))


@query("active_gpu", GP + """
SELECT snap_id, COALESCE(arg_min(gpu_index, gpu_index) FILTER (WHERE COALESCE(gpu_index, 0) = 1), arg_min(gpu_index, gpu_index)) AS gpu_index,
  COALESCE(max(temperature_celsius) FILTER (WHERE COALESCE(gpu_index, 0) = 1), arg_min(temperature_celsius, gpu_index)) AS temperature_celsius
FROM g GROUP BY snap_id
""")
def q_active_gpu(spark, sf):
    a = HW.active_gpu(F.col("gpus"), 1)
    return gpu_lists(spark, sf).select("snap_id", a["gpu_index"].alias("gpu_index"), a["temperature_celsius"].alias("temperature_celsius"))


@query("node_source", GP + f""", n AS ({nodes_sql(D)})
SELECT g0.snap_id, COALESCE(n5.primary_power, g0.power_watts) AS shown_power, n5.primary_power IS NOT NULL AS from_node
FROM (SELECT * FROM g WHERE gpu_index = 0) g0 LEFT JOIN (SELECT * FROM n WHERE node = 'node-5') n5 USING (snap_id)
""")
def q_node_source(spark, sf):
    g0 = gpus(spark, sf).where(F.col("gpu_index") == 0).select("snap_id", "power_watts")
    n5 = spark.sql(nodes_sql(fx.SPARK), lineitem=_li(spark, sf)).where(F.col("node") == "node-5").select("snap_id", "primary_power")
    j = g0.join(n5, "snap_id", "left")
    return j.select("snap_id", F.coalesce("primary_power", "power_watts").alias("shown_power"),
                    F.col("primary_power").isNotNull().alias("from_node"))


def _xid_sql(d) -> str:
    return _s(f"""SELECT 'host-' || CAST(o_orderkey % 10 AS STRING) AS host, CAST(1704067200000 + o_orderkey * 1000 AS BIGINT) AS ts,
  o_orderkey AS src, CAST(NULL AS INT) AS gpu_index, 'xid' AS event_type FROM {d.t('orders')} WHERE o_orderpriority = '1-URGENT'""", d)


@query("event_scope", GP + f""", x AS ({_xid_sql(D)}),
e AS (SELECT host, ts, snap_id AS src, gpu_index, 'gpu' AS event_type FROM g WHERE temperature_celsius >= 90 UNION ALL SELECT * FROM x)
SELECT * FROM e WHERE gpu_index IS NULL OR gpu_index = 1
""")
def q_event_scope(spark, sf):
    g = gpus(spark, sf).where(F.col("temperature_celsius") >= 90).select(
        "host", "ts", F.col("snap_id").alias("src"), "gpu_index", F.lit("gpu").alias("event_type"))
    x = spark.sql(_xid_sql(fx.SPARK), orders=tables.read(spark, sf, "orders", "o_orderkey", "o_orderpriority"))
    e = g.unionByName(x)
    return e.where(HW.event_scope(F.col("gpu_index"), F.lit(1)))


# ---------------------------------------------------------------- memory

def mem_with_gpu(spark, sf):
    m = spark.sql(memory_sql(fx.SPARK), orders=tables.read(spark, sf, "orders", "o_orderkey", "o_custkey"))
    g0 = gpus(spark, sf).where(F.col("gpu_index") == 0).select(
        "snap_id", F.col("name").alias("gpu_name"), F.col("memory_total_bytes").alias("gpu_total"),
        F.col("memory_used_bytes").alias("gpu_used"))
    m = m.join(g0, "snap_id", "left")
    return m.withColumn("is_unified", HW.memory_topology(F.col("gpu_name"), F.col("gpu_total"), F.col("total_bytes")))


_UNI = " OR ".join(f"contains(lower(gpu_name), '{f.lower()}')" for f in HW.UNIFIED_FAMILIES)
MEM = f"""WITH g AS ({gpus_sql(D)}), m0 AS ({memory_sql(D)}),
m AS (SELECT m0.*, g.name AS gpu_name, g.memory_total_bytes AS gpu_total, g.memory_used_bytes AS gpu_used
      FROM m0 LEFT JOIN (SELECT * FROM g WHERE gpu_index = 0) g USING (snap_id)),
t AS (SELECT *, COALESCE({_UNI}, FALSE) OR COALESCE(gpu_total IS NOT NULL AND total_bytes > 0
        AND CAST(abs(gpu_total - total_bytes) AS DOUBLE) <= CAST(total_bytes AS DOUBLE) * 0.10, FALSE) AS is_unified FROM m)
"""


@query("memory_topology", MEM + "SELECT snap_id, gpu_name, gpu_total, total_bytes, is_unified FROM t")
def q_memory_topology(spark, sf):
    return mem_with_gpu(spark, sf).select("snap_id", "gpu_name", "gpu_total", "total_bytes", "is_unified")


@query("memory_headline", MEM + f"""
SELECT snap_id, CASE WHEN gpu_total IS NOT NULL AND gpu_total >= total_bytes THEN gpu_total
  WHEN is_unified THEN CASE WHEN total_bytes = 0 THEN 0 ELSE
    CAST(CASE WHEN (total_bytes + {GIB - 1}) // {GIB} <= 1 THEN (total_bytes + {GIB - 1}) // {GIB}
         ELSE pow(2, ceil(log2((total_bytes + {GIB - 1}) // {GIB}))) END AS BIGINT) * {GIB} END
  ELSE total_bytes END AS display_total_bytes
FROM t
""")
def q_memory_headline(spark, sf):
    m = mem_with_gpu(spark, sf)
    return m.select("snap_id", HW.memory_headline(F.col("is_unified"), F.col("gpu_total"), F.col("total_bytes")).alias("display_total_bytes"))


def _split_sql(variant: str, gpu: str) -> str:
    used = "greatest(total_bytes - available_bytes, 0)"
    cached = "least(cached_bytes, available_bytes)"
    return f"""
SELECT snap_id, '{variant}' AS variant, {used} AS used_bytes, {gpu} AS gpu_part_bytes, greatest({used} - {gpu}, 0) AS cpu_part_bytes,
  {cached} AS cached_shown_bytes, greatest(available_bytes - {cached}, 0) AS free_bytes,
  CASE WHEN total_bytes > 0 THEN {used} / total_bytes * 100.0 ELSE 0.0 END AS used_pct,
  CASE WHEN NOT is_unified AND COALESCE(gpu_total, 0) > 0 THEN greatest(COALESCE(gpu_total, 0) - COALESCE(gpu_used, 0), 0) END AS vram_free_bytes
FROM t"""


@query("memory_split", MEM + _split_sql("card", "CASE WHEN is_unified THEN COALESCE(gpu_estimated_bytes, 0) ELSE 0 END")
       + " UNION ALL " + _split_sql("gauge", "COALESCE(gpu_estimated_bytes, 0)"))
def q_memory_split(spark, sf):
    """The card's split, with a GPU part on unified memory only, and the gauge's, with the GPU's estimate on any."""
    m = mem_with_gpu(spark, sf)
    vt, vu = F.coalesce("gpu_total", F.lit(0)), F.coalesce("gpu_used", F.lit(0))
    parts = lambda name, own: F.struct(F.lit(name).alias("variant"), *HW.memory_split(
        F.col("total_bytes"), F.col("available_bytes"), F.col("cached_bytes"), F.col("gpu_estimated_bytes"), own))
    both = F.array(parts("card", F.col("is_unified")), parts("gauge", F.lit(True)))
    return m.select("snap_id", F.when(~F.col("is_unified") & (vt > 0), F.greatest(vt - vu, F.lit(0))).alias("vram_free_bytes"), F.inline(both))


@query("gpu_process_memory", f"""
SELECT snap_id, gpu_index, CASE WHEN bool_and(supported) THEN CAST(sum(COALESCE(used_bytes, 0)) AS BIGINT) END AS gpu_estimated_bytes
FROM ({procs_sql(D)}) p GROUP BY snap_id, gpu_index
""")
def q_gpu_process_memory(spark, sf):
    p = spark.sql(procs_sql(fx.SPARK), lineitem=_li(spark, sf))
    return p.groupBy("snap_id", "gpu_index").agg(
        F.when(F.bool_and("supported"), F.sum(F.coalesce("used_bytes", F.lit(0))).cast("bigint")).alias("gpu_estimated_bytes"))


# ---------------------------------------------------------------- disks, NICs, CPU

@query("disk_totals", f"""
SELECT snap_id, CAST(sum(read_bytes) AS BIGINT) AS read_bytes_per_sec, CAST(sum(write_bytes) AS BIGINT) AS write_bytes_per_sec,
  NULLIF(arg_max(name, (total_space, ord)), '') AS name
FROM ({disks_sql(D)}) d GROUP BY snap_id
""")
def q_disk_totals(spark, sf):
    return HW.disk_totals(spark.sql(disks_sql(fx.SPARK), lineitem=_li(spark, sf)), ["snap_id"])


_VIRT = "regexp_matches(name, '^(" + "|".join(p.replace("-", "\\-") for p in HW.VIRTUAL_PREFIXES) + ")')"
_GLOBAL = ("CASE WHEN regexp_matches(lower(trim(address)), '^\\d+\\.\\d+\\.\\d+\\.\\d+$') THEN NOT (regexp_matches(lower(trim(address)), '^127\\.') "
           "OR lower(trim(address)) = '0.0.0.0' OR regexp_matches(lower(trim(address)), '^169\\.254\\.')) "
           "ELSE NOT (lower(trim(address)) = '::1' OR lower(trim(address)) = '::' OR regexp_matches(lower(trim(address)), '^fe[89ab][0-9a-f]:')) END")


def nics(spark, sf):
    n = spark.sql(nics_sql(fx.SPARK), lineitem=_li(spark, sf))
    return n.withColumn("is_virtual", HW.is_virtual_interface(F.col("name"))).withColumn("has_global_ip", HW.is_global_ip(F.col("address")))


@query("nic_classify", f"SELECT snap_id, ord, name, address, {_VIRT} AS is_virtual, {_GLOBAL} AS has_global_ip FROM ({nics_sql(D)}) n")
def q_nic_classify(spark, sf):
    return nics(spark, sf).select("snap_id", "ord", "name", "address", "is_virtual", "has_global_ip")


@query("network_totals", f"""
WITH n AS (SELECT *, {_VIRT} AS v, {_GLOBAL} AS gip, rx + tx AS traffic FROM ({nics_sql(D)}) x),
a AS (SELECT snap_id, count_if(NOT v) AS n_real,
  CAST(sum(rx) FILTER (WHERE NOT v) AS BIGINT) AS rx_real, CAST(sum(tx) FILTER (WHERE NOT v) AS BIGINT) AS tx_real,
  CAST(sum(rx) AS BIGINT) AS rx_all, CAST(sum(tx) AS BIGINT) AS tx_all,
  arg_max(name, (gip, traffic, -ord)) FILTER (WHERE NOT v) AS p_real, arg_max(name, (traffic, -ord)) AS p_all
  FROM n GROUP BY snap_id)
SELECT snap_id, CASE WHEN n_real > 0 THEN p_real ELSE p_all END AS name,
  CASE WHEN n_real > 0 THEN rx_real ELSE rx_all END AS rx_bytes_per_sec,
  CASE WHEN n_real > 0 THEN tx_real ELSE tx_all END AS tx_bytes_per_sec FROM a
""")
def q_network_totals(spark, sf):
    return HW.network_totals(nics(spark, sf), ["snap_id"])


@query("cpu_cores", f"""
SELECT snap_id, core_id, usage_percent, avg(usage_percent) OVER w AS aggregate_percent, count(*) OVER w AS n_cores,
  NULLIF(first_value(brand) OVER (PARTITION BY snap_id ORDER BY core_id), '') AS name
FROM ({cores_sql(D)}) c WINDOW w AS (PARTITION BY snap_id)
""")
def q_cpu_cores(spark, sf):
    """Every core's usage beside its host's mean, core count and brand."""
    cores = spark.sql(cores_sql(fx.SPARK), lineitem=_li(spark, sf))
    return HW.cpu_cores(cores, ["snap_id"]).join(cores.select("snap_id", "core_id", "usage_percent"), "snap_id")


# ---------------------------------------------------------------- power

@query("power_scale", GP + """
, p AS (SELECT *, max(power_watts) OVER (PARTITION BY host, gpu_index ORDER BY ts RANGE BETWEEN 300000 PRECEDING AND CURRENT ROW) AS peak FROM g),
c AS (SELECT *, CASE WHEN peak > 0 THEN
        (CASE WHEN peak / pow(10, floor(log10(peak))) <= 1 THEN 1.0 WHEN peak / pow(10, floor(log10(peak))) <= 2 THEN 2.0
              WHEN peak / pow(10, floor(log10(peak))) <= 5 THEN 5.0 ELSE 10.0 END) * pow(10, floor(log10(peak))) END AS ceil_ FROM p)
SELECT host, gpu_index, ts, snap_id,
  CASE WHEN (CASE WHEN power_limit_watts > 0 THEN power_limit_watts WHEN ceil_ > 0 THEN ceil_ END) > 0 AND power_watts IS NOT NULL
       THEN least(greatest(power_watts / (CASE WHEN power_limit_watts > 0 THEN power_limit_watts WHEN ceil_ > 0 THEN ceil_ END) * 100.0, 0.0), 100.0)
       ELSE 0.0 END AS percent,
  CASE WHEN power_limit_watts > 0 THEN power_limit_watts WHEN ceil_ > 0 THEN ceil_ END AS effective_max,
  CASE WHEN power_limit_watts > 0 THEN 'limit' WHEN ceil_ > 0 THEN 'peak' END AS source
FROM c
""")
def q_power_scale(spark, sf):
    """The gauge of every reading, against the peak of the chart's window (5 minutes up to the reading)."""
    g = gpus(spark, sf).select("host", "gpu_index", "ts", "snap_id", "power_watts", "power_limit_watts")
    usable = F.when(~F.isnan("power_watts") & (F.abs("power_watts") < F.lit(float("inf"))), F.col("power_watts"))
    g = sliding_max(g.withColumn("_power", usable), ["host", "gpu_index"], "ts", "_power", TRAILING["5m"], "peak")
    return g.select("host", "gpu_index", "ts", "snap_id",
                    *HW.power_scale(F.col("power_watts"), F.col("power_limit_watts"), F.col("peak")))


@query("cluster_power", GP + f""", n AS ({nodes_sql(D)}),
l AS (SELECT snap_id, sum(power_watts) AS s, count(*) AS k, arg_min(power_watts, gpu_index) AS p0 FROM g GROUP BY snap_id),
r AS (SELECT snap_id, sum(primary_power) FILTER (WHERE online) AS rs FROM n GROUP BY snap_id),
x AS (SELECT l.snap_id, CASE WHEN k = 0 THEN p0 WHEN s > 0 THEN s ELSE p0 END AS loc, COALESCE(r.rs, 0.0) AS rem
      FROM l LEFT JOIN r USING (snap_id))
SELECT snap_id, CASE WHEN loc IS NOT NULL AND rem > 0 THEN loc + rem WHEN loc IS NOT NULL THEN loc WHEN rem > 0 THEN rem END AS power_watts FROM x
""")
def q_cluster_power(spark, sf):
    g = gpus(spark, sf).groupBy("snap_id").agg(F.sum("power_watts").alias("s"), F.count(F.lit(1)).alias("k"),
                                               F.min_by("power_watts", "gpu_index").alias("p0"))
    n = spark.sql(nodes_sql(fx.SPARK), lineitem=_li(spark, sf)).groupBy("snap_id").agg(
        F.sum(F.when(F.col("online"), F.col("primary_power"))).alias("rs"))
    j = g.join(n, "snap_id", "left")
    return j.select("snap_id", HW.cluster_power(F.col("s"), F.col("k"), F.col("p0"), F.col("rs")).alias("power_watts"))


# ---------------------------------------------------------------- band variants

@query("severity_bands_variants", GP + f""", c AS ({cores_sql(D)}), s AS ({fx.sql_engine_snapshots(D)})
SELECT 'temp' AS variant, CAST(snap_id AS VARCHAR) || ':' || CAST(gpu_index AS VARCHAR) AS item,
  CASE WHEN temperature_celsius IS NULL THEN 'unknown' WHEN temperature_celsius >= 85 THEN 'critical' WHEN temperature_celsius >= 70 THEN 'warning' ELSE 'healthy' END AS band FROM g
UNION ALL SELECT 'node_temp', CAST(snap_id AS VARCHAR) || ':' || CAST(gpu_index AS VARCHAR),
  CASE WHEN temperature_celsius >= 80 THEN 'critical' WHEN temperature_celsius >= 70 THEN 'warning' ELSE 'healthy' END FROM g
UNION ALL SELECT 'core_heat', CAST(snap_id AS VARCHAR) || ':' || CAST(core_id AS VARCHAR),
  CASE WHEN usage_percent >= 90 THEN 'critical' WHEN usage_percent >= 70 THEN 'warning' WHEN usage_percent >= 40 THEN 'busy'
       WHEN usage_percent >= 10 THEN 'light' ELSE 'idle' END FROM c
UNION ALL SELECT 'goodput', CAST(tick_ts AS VARCHAR) || ':' || engine_key,
  CASE WHEN ttft_goodput_pct IS NULL THEN 'none' WHEN ttft_goodput_pct >= 99 THEN 'healthy' WHEN ttft_goodput_pct >= 90 THEN 'warning' ELSE 'critical' END FROM s
UNION ALL SELECT 'acceptance', CAST(tick_ts AS VARCHAR) || ':' || engine_key,
  CASE WHEN spec_decode_acceptance_rate_live IS NULL THEN 'none' WHEN spec_decode_acceptance_rate_live >= 70 THEN 'healthy'
       WHEN spec_decode_acceptance_rate_live >= 40 THEN 'warning' ELSE 'critical' END FROM s
UNION ALL SELECT 'kv_bar', CAST(tick_ts AS VARCHAR) || ':' || engine_key,
  CASE WHEN kv_cache_percent > 90 THEN 'critical' WHEN kv_cache_percent > 70 THEN 'warning' ELSE 'healthy' END FROM s
""")
def q_severity_bands_variants(spark, sf):
    g = gpus(spark, sf)
    c = spark.sql(cores_sql(fx.SPARK), lineitem=_li(spark, sf))
    s = fx.engine_snapshots(spark, sf)
    gi = F.concat_ws(":", F.col("snap_id").cast("string"), F.col("gpu_index").cast("string"))
    se = F.concat_ws(":", F.col("tick_ts").cast("string"), F.col("engine_key"))
    t = F.col("temperature_celsius")
    parts = [
        g.select(F.lit("temp").alias("variant"), gi.alias("item"), HW.band(t, 70, 85, unknown="unknown").alias("band")),
        g.select(F.lit("node_temp").alias("variant"), gi.alias("item"), HW.band(t, 70, 80).alias("band")),
        c.select(F.lit("core_heat").alias("variant"),
                 F.concat_ws(":", F.col("snap_id").cast("string"), F.col("core_id").cast("string")).alias("item"),
                 HW.core_heat(F.col("usage_percent")).alias("band")),
        s.select(F.lit("goodput").alias("variant"), se.alias("item"), HW.band(F.col("ttft_goodput_pct"), 90, 99, higher_is_better=True).alias("band")),
        s.select(F.lit("acceptance").alias("variant"), se.alias("item"),
                 HW.band(F.col("spec_decode_acceptance_rate_live"), 40, 70, higher_is_better=True).alias("band")),
        s.select(F.lit("kv_bar").alias("variant"), se.alias("item"), HW.band(F.col("kv_cache_percent"), 70, 90, inclusive=False).alias("band")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
