"""Hardware readings: throttle events, power limits, severity bands, event classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# NVML throttle-reason bits.
SW_POWER_CAP = 0x4
HW_SLOWDOWN = 0x8
SW_THERMAL = 0x20
HW_THERMAL = 0x40
HW_POWER_BRAKE = 0x80

# Fixed values: (metric, warning, critical), bands are inclusive (>=).
THRESHOLDS = (("gpu_temp", 70.0, 85.0), ("gpu_power_pct", 80.0, 95.0), ("cpu_util", 80.0, 95.0),
              ("mem_used_pct", 80.0, 95.0), ("kv_cache_pct", 70.0, 90.0))


def throttle_events(readings: DataFrame, mask: str = "throttle_mask") -> DataFrame:
    """0..4 events per GPU and tick from the throttle bitmask, in the fixed order thermal, throttle, power_brake, throttle."""
    m = F.col(mask)
    ev = F.array_compact(F.array(
        F.when((m.bitwiseAND(HW_THERMAL) != 0) | (m.bitwiseAND(SW_THERMAL) != 0),
               F.struct(F.lit(0).alias("ord"), F.lit("thermal").alias("event_type"), F.lit("Thermal throttling active").alias("detail"))),
        F.when(m.bitwiseAND(HW_SLOWDOWN) != 0,
               F.struct(F.lit(1).alias("ord"), F.lit("throttle").alias("event_type"), F.lit("Hardware slowdown engaged").alias("detail"))),
        F.when(m.bitwiseAND(HW_POWER_BRAKE) != 0,
               F.struct(F.lit(2).alias("ord"), F.lit("power_brake").alias("event_type"), F.lit("Power brake engaged").alias("detail"))),
        F.when(m.bitwiseAND(SW_POWER_CAP) != 0,
               F.struct(F.lit(3).alias("ord"), F.lit("throttle").alias("event_type"), F.lit("Software power cap limiting clocks").alias("detail"))),
    ))
    keep = [c for c in readings.columns if c != mask]
    return readings.select(*keep, F.explode(ev).alias("_e")).select(*keep, "_e.ord", "_e.event_type", "_e.detail")


def power_limit_watts(*limits_mw: Column) -> Column:
    """First non-null of the limit sources, kept only if > 0, milliwatts -> watts (a zero first value is not skipped)."""
    first = F.coalesce(*limits_mw)
    return F.when(first > 0, first / 1000.0)


def event_severity(event_type: Column) -> Column:
    return F.when(event_type.isin("thermal", "xid"), "critical").otherwise("warning")


def event_group(event_type: Column) -> Column:
    """GPU-scoped events split into thermal and throttle groups; anything else in neither."""
    return F.when(event_type == "thermal", "thermal").when(event_type.isin("throttle", "power_brake"), "throttle")


def thresholds_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(THRESHOLDS), "metric string, warning double, critical double")


def severity_bands(spark: SparkSession, readings: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """healthy / warning / critical per reading via the (broadcast, fixed-size) thresholds table."""
    t = F.broadcast(thresholds_df(spark))
    j = readings.join(t, metric, "inner")
    band = F.when(F.col(value) >= F.col("critical"), "critical").when(F.col(value) >= F.col("warning"), "warning").otherwise("healthy")
    return j.withColumn("band", band).drop("warning", "critical")


# ---------------------------------------------------------------- GPUs of a snapshot

def gpu_array(gpus: DataFrame, keys: list[str]) -> DataFrame:
    """Per snapshot: the GPU list (sorted by index) -- bounded by the GPUs of one host."""
    g = gpus.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in gpus.columns if c not in keys]))).alias("gpus"))
    return g


def gpu_select(gpus: Column, index) -> Column:
    """Optional single-GPU filter: None keeps all; an index not present gives an empty list."""
    if index is None:
        return gpus
    return F.filter(gpus, lambda g: g["gpu_index"] == F.lit(index))


def gpus_or_single(gpus: Column, gpu: Column) -> Column:
    """The list, or the snapshot's single GPU where the list is missing or empty."""
    return F.when(F.size(gpus) > 0, gpus).otherwise(F.array(gpu))


def primary_gpu(gpus: Column) -> Column:
    """First GPU of the list, or null (an all-null GPU) when the list is empty."""
    return F.try_element_at(gpus, F.lit(1))


def active_gpu(gpus: Column, selected) -> Column:
    """The selected GPU (null index counts as 0) else the first one."""
    sel = F.try_element_at(F.filter(gpus, lambda g: F.coalesce(g["gpu_index"], F.lit(0)) == F.lit(selected)), F.lit(1))
    return F.coalesce(sel, F.try_element_at(gpus, F.lit(1)))


def event_scope(event_gpu: Column, active_index: Column) -> Column:
    """An event applies to the GPU when it has no index or the same index."""
    return event_gpu.isNull() | (event_gpu == active_index)


# ---------------------------------------------------------------- memory

# GPU name families with unified CPU/GPU memory (matched case-insensitively).
UNIFIED_FAMILIES = ("GB10", "GB200", "GB300", "GH200", "Grace", "Spark", "Jetson", "Tegra", "Orin", "Xavier",
                    "Thor", "TX1", "TX2", "Nano", "AGX", "DRIVE")
GIB = 1 << 30


def memory_topology(gpu_name: Column, gpu_total: Column, sys_total: Column) -> Column:
    """Unified when the GPU name names a unified family, or |gpu - sys| <= 10 % of sys (sys > 0)."""
    pat = "(?i)(" + "|".join(UNIFIED_FAMILIES) + ")"
    by_name = F.coalesce(gpu_name.rlike(pat), F.lit(False))
    by_size = F.coalesce(gpu_total.isNotNull() & (sys_total > 0)
                         & (F.abs(gpu_total - sys_total).cast("double") <= sys_total.cast("double") * 0.10), F.lit(False))
    return by_name | by_size


def round_up_to_marketed_gib(b: Column) -> Column:
    """0 -> 0; else ceil to GiB, then the next power of two GiB (integer bit arithmetic)."""
    g = F.floor((b + F.lit(GIB - 1)) / F.lit(GIB)).cast("bigint")
    pow2 = F.when(g <= 1, g).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(g - 1))))
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(pow2 * F.lit(GIB))


def memory_headline(is_unified: Column, gpu_total: Column, sys_total: Column) -> Column:
    """NVML total when >= kernel total; else marketed size when unified; else kernel total."""
    return (F.when(gpu_total.isNotNull() & (gpu_total >= sys_total), gpu_total)
            .when(is_unified, round_up_to_marketed_gib(sys_total)).otherwise(sys_total))


def memory_split(total: Column, available: Column, cached: Column, gpu_est: Column, own_gpu: Column) -> list[Column]:
    """Used / GPU part / CPU part / cached / free / used percent. The GPU's estimate counts where ``own_gpu`` holds."""
    used = F.greatest(total - available, F.lit(0))
    gpu = F.when(own_gpu, F.coalesce(gpu_est, F.lit(0))).otherwise(F.lit(0))
    cach = F.least(cached, available)
    return [
        used.alias("used_bytes"), gpu.alias("gpu_part_bytes"), F.greatest(used - gpu, F.lit(0)).alias("cpu_part_bytes"),
        cach.alias("cached_shown_bytes"), F.greatest(available - cach, F.lit(0)).alias("free_bytes"),
        F.when(total > 0, used / total * 100.0).otherwise(F.lit(0.0)).alias("used_pct"),
    ]


# ---------------------------------------------------------------- disks, NICs, CPU

# Interface-name prefixes of virtual interfaces.
VIRTUAL_PREFIXES = ("lo", "docker", "veth", "br-", "virbr", "vnet", "vmnet", "tun", "tap", "wg", "tailscale", "zt",
                    "utun", "llw", "awdl", "bridge", "gif", "stf", "anpi", "cni", "flannel", "cali", "cilium", "kube",
                    "dummy", "ifb", "lxc", "lxd", "nerdctl")


def is_virtual_interface(name: Column) -> Column:
    return name.rlike("^(" + "|".join(p.replace("-", r"\-") for p in VIRTUAL_PREFIXES) + ")")


def is_global_ip(addr: Column) -> Column:
    """Not loopback, unspecified or link-local (IPv4 and IPv6 text forms)."""
    a = F.lower(F.trim(addr))
    v4 = a.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    v4_bad = a.rlike(r"^127\.") | (a == "0.0.0.0") | a.rlike(r"^169\.254\.")
    v6_bad = (a == "::1") | (a == "::") | a.rlike(r"^fe[89ab][0-9a-f]:")
    return F.when(v4, ~v4_bad).otherwise(~v6_bad)


def disk_totals(disks: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of read/write; the largest disk's name (last on ties), blank -> null."""
    g = disks.groupBy(*keys).agg(
        F.sum("read_bytes").alias("read_bytes_per_sec"), F.sum("write_bytes").alias("write_bytes_per_sec"),
        F.max_by("name", F.struct("total_space", "ord")).alias("_name"))
    return g.withColumn("name", F.when(F.col("_name") != "", F.col("_name"))).drop("_name")


def network_totals(nics: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over real interfaces; primary = max (global ip, traffic), first on ties.

    With no real interface: totals over all, primary = most traffic, first on ties.
    """
    d = nics.withColumn("_virt", is_virtual_interface(F.col("name"))).withColumn("_traffic", F.col("rx") + F.col("tx"))
    g = d.groupBy(*keys).agg(
        F.count_if(~F.col("_virt")).alias("_real"),
        F.sum(F.when(~F.col("_virt"), F.col("rx"))).alias("_rx_real"), F.sum(F.when(~F.col("_virt"), F.col("tx"))).alias("_tx_real"),
        F.sum("rx").alias("_rx_all"), F.sum("tx").alias("_tx_all"),
        F.max_by(F.when(~F.col("_virt"), F.col("name")),
                 F.when(~F.col("_virt"), F.struct(F.col("has_global_ip"), F.col("_traffic"), (-F.col("ord")).alias("o")))).alias("_p_real"),
        F.max_by("name", F.struct(F.col("_traffic"), (-F.col("ord")).alias("o"))).alias("_p_all"),
    )
    real = F.col("_real") > 0
    return g.select(*keys, F.when(real, F.col("_p_real")).otherwise(F.col("_p_all")).alias("name"),
                    F.when(real, F.col("_rx_real")).otherwise(F.col("_rx_all")).alias("rx_bytes_per_sec"),
                    F.when(real, F.col("_tx_real")).otherwise(F.col("_tx_all")).alias("tx_bytes_per_sec"))


def cpu_cores(cores: DataFrame, keys: list[str]) -> DataFrame:
    """Host aggregate of per-core rows: mean usage, core count, brand of the first core (blank -> null)."""
    g = cores.groupBy(*keys).agg(F.avg("usage_percent").alias("aggregate_percent"), F.count(F.lit(1)).alias("n_cores"),
                                 F.min_by("brand", "core_id").alias("_brand"))
    return g.withColumn("name", F.when(F.col("_brand") != "", F.col("_brand"))).drop("_brand")


# ---------------------------------------------------------------- power

def nice_ceiling(v: Column) -> Column:
    """Round up on a 1-2-5 x 10^n grid; null for non-positive or non-finite values."""
    mag = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    frac = v / mag
    nice = F.when(frac <= 1, 1.0).when(frac <= 2, 2.0).when(frac <= 5, 5.0).otherwise(10.0)
    return F.when((v > 0) & (v != F.lit(float("inf"))), nice * mag)


def power_scale(current: Column, limit: Column, peak: Column) -> list[Column]:
    """Gauge denominator (limit if > 0 else nice ceiling of the peak), percent clamped 0..100, source tag."""
    ceil_ = nice_ceiling(peak)
    eff = F.when(limit > 0, limit).when(ceil_ > 0, ceil_)
    src = F.when(limit > 0, "limit").when(ceil_ > 0, "peak")
    pct = F.when(current.isNotNull() & ~F.isnan(current) & (eff > 0), F.least(F.greatest(current / eff * 100.0, F.lit(0.0)), F.lit(100.0))).otherwise(F.lit(0.0))
    return [pct.alias("percent"), eff.alias("effective_max"), src.alias("source")]


def cluster_power(local_sum: Column, n_gpus: Column, primary_power: Column, remote_sum: Column) -> Column:
    """Local = sum of GPU power if > 0 else the primary GPU's; plus the online remote nodes' primary power."""
    local = F.when(n_gpus == 0, primary_power).otherwise(F.when(local_sum > 0, local_sum).otherwise(primary_power))
    remote = F.coalesce(remote_sum, F.lit(0.0))
    return (F.when(local.isNotNull() & (remote > 0), local + remote).when(local.isNotNull(), local)
            .when(remote > 0, remote))


# ---------------------------------------------------------------- band variants

def band(v: Column, warning: float, critical: float, inclusive: bool = True, higher_is_better: bool = False,
         unknown: str | None = None) -> Column:
    """Three-level band with configurable cuts.

    Lower is better by default (>= critical -> critical, >= warning -> warning);
    ``inclusive=False`` uses strict ``>``; ``higher_is_better`` inverts (>= critical
    -> healthy, >= warning -> warning, else critical) and maps null to ``none``.
    """
    if higher_is_better:
        return F.when(v.isNull(), "none").when(v >= critical, "healthy").when(v >= warning, "warning").otherwise("critical")
    ge = (lambda c: v >= c) if inclusive else (lambda c: v > c)
    b = F.when(ge(critical), "critical").when(ge(warning), "warning").otherwise("healthy")
    return F.when(v.isNull(), unknown).otherwise(b) if unknown is not None else F.when(v.isNull(), "healthy").otherwise(b)


def core_heat(usage: Column) -> Column:
    """Per-core heat map class: 90 / 70 / 40 / 10 cut points."""
    return (F.when(usage >= 90, "critical").when(usage >= 70, "warning").when(usage >= 40, "busy")
            .when(usage >= 10, "light").otherwise("idle"))
