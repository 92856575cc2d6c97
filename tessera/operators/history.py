"""Window summaries and time-series queries over the three tiers.

Windows ``(window_id, since_ms, until_ms)`` are a list of parameters or a
table (see ``in_windows``); many report windows are answered in one scan of
a tier. Tier choice by
range is decided in Python from the literals (``choose_tier``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeutil import DAY_MS, HOUR_MS, bucket, idiv
from ..sources.tier_store import bounded

# Metric -> (raw column, rollup column or None).
METRIC_COLUMNS = {
    "prompt_tps": ("prompt_tps", "prompt_tps_avg"),
    "decode_tps": ("decode_tps", "decode_tps_avg"),
    "ttft_ms": ("ttft_ms", "ttft_ms_p95"),
    "itl_ms": ("itl_ms", "itl_ms_p95"),
    "e2e_ms": ("e2e_ms", "e2e_ms_p95"),
    "active_requests": ("active_requests", "active_requests_max"),
    "queued_requests": ("queued_requests", "queued_requests_max"),
    "total_requests": ("total_requests", "total_requests"),
    "kv_cache_pct": ("kv_cache_pct", "kv_cache_pct_max"),
    "prefix_cache_hit": ("prefix_cache_hit", "prefix_cache_hit_avg"),
    "gpu_util": ("gpu_util", "gpu_util_avg"),
    "gpu_temp": ("gpu_temp", "gpu_temp_max"),
    "power_watts": ("power_watts", "power_watts_sum"),
    "cpu_util": ("cpu_util", "cpu_util_avg"),
    "mem_used_pct": ("mem_used_pct", None),
    "preemptions_total": ("preemptions_total", "preemptions_total"),
    "queue_time_ms": ("queue_time_ms", "queue_time_ms_avg"),
    "tpot_ms": ("tpot_ms", "tpot_ms_avg"),
}

# Metrics bucketed with MAX (gauges); every other name uses AVG.
MAX_METRICS = ("active_requests", "queued_requests", "kv_cache_pct", "prefix_cache_hit", "gpu_util", "gpu_temp")


def resolve_metric(metric: str) -> tuple[str, str | None] | None:
    """(raw column, rollup column) for a metric name; None for an unknown name."""
    return METRIC_COLUMNS.get(metric)


def agg_func_for_metric(metric: str) -> str:
    return "max" if metric in MAX_METRICS else "avg"


def bucket_size_ms(range_ms: int) -> int:
    """~360 buckets over the range, never finer than one second."""
    return max(range_ms // 360, 1000)


def choose_tier(range_ms: int) -> str:
    """Tier answering a time-series request of this range."""
    if range_ms <= HOUR_MS:
        return "short"
    return "hourly" if range_ms <= DAY_MS else "daily"


def windows_df(spark: SparkSession, windows: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(windows, "window_id int, since_ms long, until_ms long")


def in_windows(df: DataFrame, ts_col: str, windows: list[tuple[int, int, int]] | DataFrame) -> DataFrame:
    """Rows of ``df`` tagged with every window (window_id, since_ms, until_ms) containing ``ts_col`` (both ends inclusive).

    A list is a parameter: its bounds become literals of the scan (and, on a stored tier, of its days), and rows are
    tagged where they are. A table of windows is cut into days and joined on them; the day that bounds a comparison
    is a key, so neither side is broadcast by assumption, and a stored tier's days are pruned by the join.
    """
    t = F.col(ts_col)
    if not isinstance(windows, DataFrame):
        df = bounded(df, ts_col, [(s, u) for _, s, u in windows])
        listed = F.array(*[F.struct(F.lit(w).cast("int").alias("window_id"), F.lit(s).cast("bigint").alias("since_ms"), F.lit(u).cast("bigint").alias("until_ms"))
                           for w, s, u in windows])
        return df.select("*", F.inline(F.filter(listed, lambda w: t.between(w["since_ms"], w["until_ms"]))))
    rows = df if "day" in df.columns else df.withColumn("day", idiv(t, DAY_MS).cast("int"))
    ends = rows.agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))  # one row
    a = F.greatest(idiv(F.col("since_ms"), DAY_MS), F.col("_lo")).cast("int")
    b = F.least(idiv(F.col("until_ms"), DAY_MS), F.col("_hi")).cast("int")
    daily = windows.crossJoin(ends).where(a <= b).select(*windows.columns, F.explode(F.sequence(a, b)).alias("day"))
    out = rows.join(daily, "day").where(t.between(F.col("since_ms"), F.col("until_ms")))
    return out.select(*df.columns, *windows.columns)


# --------------------------------------------------------------------------
# summaries
# --------------------------------------------------------------------------

SUMMARY_COLUMNS = [
    "window_id", "engine_key", "delta_prompt_tokens", "delta_gen_tokens", "total_requests",
    "avg_decode_tps", "avg_prompt_tps", "peak_active_requests", "peak_queued_requests",
    "peak_kv_cache_pct", "avg_kv_cache_pct", "total_preemptions", "power_kwh", "total_seconds",
]


def _z(c: Column, zero) -> Column:
    return F.coalesce(c, F.lit(zero))


def summary_raw(raw: DataFrame, windows: list | DataFrame) -> DataFrame:
    """Per (window, engine) summary from the raw tier: one row = one second."""
    t = in_windows(raw, "ts", windows)
    return (
        t.groupBy("window_id", "engine_key")
        .agg(
            _z(F.sum("total_prompt_tokens"), 0).cast("bigint").alias("delta_prompt_tokens"),
            _z(F.sum("total_gen_tokens"), 0).cast("bigint").alias("delta_gen_tokens"),
            _z(F.sum("total_requests"), 0).cast("bigint").alias("total_requests"),
            _z(F.avg("decode_tps"), 0.0).alias("avg_decode_tps"),
            _z(F.avg("prompt_tps"), 0.0).alias("avg_prompt_tps"),
            _z(F.max("active_requests"), 0).cast("bigint").alias("peak_active_requests"),
            _z(F.max("queued_requests"), 0).cast("bigint").alias("peak_queued_requests"),
            F.max("kv_cache_pct").alias("peak_kv_cache_pct"),
            F.avg("kv_cache_pct").alias("avg_kv_cache_pct"),
            F.max("preemptions_total").cast("bigint").alias("total_preemptions"),
            (_z(F.sum("power_watts"), 0.0) / 3600.0 / 1000.0).alias("power_kwh"),
            F.count(F.lit(1)).cast("double").alias("total_seconds"),
        )
        .select(*SUMMARY_COLUMNS)
    )


def summary_weighted(tier: DataFrame, windows: list | DataFrame) -> DataFrame:
    """Per (window, engine) summary from a rollup tier, averages weighted by sample_count.

    Parity: a null average still counts in the denominator.
    """
    t = in_windows(tier, "bucket_ts", windows)
    n = F.col("sample_count")
    den = F.nullif(F.sum(n), F.lit(0))
    return (
        t.groupBy("window_id", "engine_key")
        .agg(
            _z(F.sum("total_prompt_tokens"), 0).cast("bigint").alias("delta_prompt_tokens"),
            _z(F.sum("total_gen_tokens"), 0).cast("bigint").alias("delta_gen_tokens"),
            _z(F.sum("total_requests"), 0).cast("bigint").alias("total_requests"),
            _z(F.sum(F.col("decode_tps_avg") * n) / den, 0.0).alias("avg_decode_tps"),
            _z(F.sum(F.col("prompt_tps_avg") * n) / den, 0.0).alias("avg_prompt_tps"),
            _z(F.max("active_requests_max"), 0).cast("bigint").alias("peak_active_requests"),
            _z(F.max("queued_requests_max"), 0).cast("bigint").alias("peak_queued_requests"),
            F.max("kv_cache_pct_max").alias("peak_kv_cache_pct"),
            (F.sum(F.col("kv_cache_pct_avg") * n) / den).alias("avg_kv_cache_pct"),
            F.max("preemptions_total").cast("bigint").alias("total_preemptions"),
            (_z(F.sum("power_watts_sum"), 0.0) / 3600.0 / 1000.0).alias("power_kwh"),
            _z(F.sum(n), 0).cast("double").alias("total_seconds"),
        )
        .select(*SUMMARY_COLUMNS)
    )


def summary_cascade(raw: DataFrame, hourly: DataFrame, daily: DataFrame, windows: list | DataFrame) -> DataFrame:
    """First tier (daily, hourly, raw) with any non-zero token/request count; tiers never mix."""
    parts = [
        summary_weighted(daily, windows).withColumn("tier_rank", F.lit(1)).withColumn("source_table", F.lit("daily")),
        summary_weighted(hourly, windows).withColumn("tier_rank", F.lit(2)).withColumn("source_table", F.lit("hourly")),
        summary_raw(raw, windows).withColumn("tier_rank", F.lit(3)).withColumn("source_table", F.lit("raw")),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    u = u.where((F.col("delta_prompt_tokens") > 0) | (F.col("delta_gen_tokens") > 0) | (F.col("total_requests") > 0))
    # one row per (window, engine, tier) at most three: a tiny, bounded group
    w = Window.partitionBy("window_id", "engine_key").orderBy("tier_rank")
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "tier_rank")


def energy_kwh(power_sum: Column) -> Column:
    """Energy assuming one sample per second: sum(W) / 3600 / 1000."""
    return power_sum / 3600.0 / 1000.0


def cost_savings(summary: DataFrame, settings_row: DataFrame) -> DataFrame:
    """Cloud-equivalent cost vs electricity cost per summary row.

    ``settings_row`` is the one-row settings view (string rates); a blank or
    unparsable rate counts as 0.
    """
    def rate(c: str) -> Column:
        # leading-number parse (like a lenient float parser); nothing numeric -> 0
        num = F.regexp_extract(F.col(c), r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
        return F.coalesce(num.try_cast("double"), F.lit(0.0))

    s = settings_row.select(
        rate("cloud_prompt_rate").alias("_pr"), rate("cloud_gen_rate").alias("_gr"), rate("electricity_rate").alias("_er")
    )
    j = summary.crossJoin(F.broadcast(s))  # one-row settings
    cloud = F.col("delta_prompt_tokens") / 1e6 * F.col("_pr") + F.col("delta_gen_tokens") / 1e6 * F.col("_gr")
    energy = F.col("power_kwh") * F.col("_er")
    return j.select(
        *summary.columns,
        cloud.alias("cloud_cost"),
        energy.alias("energy_cost"),
        (cloud - energy).alias("net_savings"),
        (F.col("total_seconds") / 3600.0).alias("hours_alive"),
    )


# --------------------------------------------------------------------------
# time series
# --------------------------------------------------------------------------

def unpivot_tier(tier: DataFrame, metrics=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rollup tier -> (keep, engine_key, metric, timestamp_ms, value) through the metric map.

    Power is shown as sum / sample_count; metrics without a rollup column are
    absent. Null values become 0 (parity).
    """
    metrics = metrics or list(METRIC_COLUMNS)
    arms = []
    for m in metrics:
        rc = METRIC_COLUMNS.get(m)
        if rc is None or rc[1] is None:
            continue
        c = F.col(rc[1]).cast("double")
        if m == "power_watts":
            c = c / F.nullif(F.col("sample_count"), F.lit(0))
        arms.append(F.struct(F.lit(m).alias("metric"), c.alias("value")))
    return tier.select(
        *keep, "engine_key", F.col("bucket_ts").alias("timestamp_ms"), F.explode(F.array(*arms)).alias("_m")
    ).select(*keep, "engine_key", "_m.metric", "timestamp_ms", F.coalesce("_m.value", F.lit(0.0)).alias("value"))


def bucket_raw(raw: DataFrame, bucket_ms: int, metrics=None) -> DataFrame:
    """Raw tier bucketed per (engine, metric, bucket) with the per-metric policy (MAX or AVG)."""
    metrics = metrics or list(METRIC_COLUMNS)
    arms = [
        F.struct(F.lit(m).alias("metric"), F.col(METRIC_COLUMNS[m][0]).cast("double").alias("v"))
        for m in metrics
        if m in METRIC_COLUMNS
    ]
    long = raw.select(
        "engine_key", bucket(F.col("ts"), bucket_ms).alias("timestamp_ms"), F.explode(F.array(*arms)).alias("_m")
    ).select("engine_key", "timestamp_ms", "_m.metric", "_m.v")
    g = long.groupBy("engine_key", "metric", "timestamp_ms").agg(F.max("v").alias("_mx"), F.avg("v").alias("_av"))
    val = F.when(F.col("metric").isin(*MAX_METRICS), F.col("_mx")).otherwise(F.col("_av"))
    return g.select("engine_key", "metric", "timestamp_ms", F.coalesce(val, F.lit(0.0)).alias("value"))


def timeseries_short(raw_remainder: DataFrame, hourly: DataFrame, windows: list | DataFrame, range_ms: int) -> DataFrame:
    """Range <= 1 h: hourly buckets in range UNION ALL raw buckets of ``max(range/360, 1 s)``."""
    b = bucket_size_ms(range_ms)
    hours = unpivot_tier(in_windows(hourly, "bucket_ts", windows), keep=("window_id",)).withColumn("source", F.lit("hourly"))
    raw_w = in_windows(raw_remainder, "ts", windows)
    pts = (
        bucket_raw_windowed(raw_w, b)
        .withColumn("source", F.lit("raw"))
    )
    cols = ["window_id", "engine_key", "metric", "timestamp_ms", "value", "source"]
    return hours.select(*cols).unionByName(pts.select(*cols))


def bucket_raw_windowed(raw_w: DataFrame, bucket_ms: int) -> DataFrame:
    """``bucket_raw`` keeping the window id of a window-tagged raw frame."""
    arms = [F.struct(F.lit(m).alias("metric"), F.col(rc).cast("double").alias("v")) for m, (rc, _) in METRIC_COLUMNS.items()]
    long = raw_w.select(
        "window_id", "engine_key", bucket(F.col("ts"), bucket_ms).alias("timestamp_ms"), F.explode(F.array(*arms)).alias("_m")
    ).select("window_id", "engine_key", "timestamp_ms", "_m.metric", "_m.v")
    g = long.groupBy("window_id", "engine_key", "metric", "timestamp_ms").agg(F.max("v").alias("_mx"), F.avg("v").alias("_av"))
    val = F.when(F.col("metric").isin(*MAX_METRICS), F.col("_mx")).otherwise(F.col("_av"))
    return g.select("window_id", "engine_key", "metric", "timestamp_ms", F.coalesce(val, F.lit(0.0)).alias("value"))


def timeseries_long(tier: DataFrame, windows: list | DataFrame) -> DataFrame:
    """Range > 1 h: projection of the chosen rollup tier (``choose_tier``)."""
    pts = unpivot_tier(in_windows(tier, "bucket_ts", windows), keep=("window_id",))
    return pts.select("window_id", "engine_key", "metric", "timestamp_ms", "value")


def series_order(points: DataFrame, key_cols=("engine_key", "metric"), ts_col="timestamp_ms") -> DataFrame:
    """Ascending timestamp order, materialised as a 0-based position per series."""
    w = Window.partitionBy(*key_cols).orderBy(ts_col)
    return points.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).orderBy(*key_cols, ts_col)


# --------------------------------------------------------------------------
# calendar windows
# --------------------------------------------------------------------------

# Preset names.
PRESETS = ("today", "this_week", "this_month", "last_month", "this_year", "all_time")


def chosen_window(now: DataFrame, offset_hours: Column, preset: str = "preset", since: str = "custom_since", until: str = "custom_until") -> DataFrame:
    """The window of each row's own preset. ``custom`` takes the row's times (no end: now); an unknown preset is today's."""
    known = F.col("_preset").isin(*PRESETS, "custom")
    w = calendar_windows(now.withColumnRenamed(preset, "_preset"), offset_hours)
    wanted = F.when(F.col("_preset") == "custom", "today").when(known, F.col("_preset")).otherwise("today")
    w = w.where(F.col("preset") == wanted)
    own = F.col("_preset") == "custom"
    return w.withColumn("since_ms", F.when(own, F.col(since)).otherwise(F.col("since_ms"))).withColumn(
        "until_ms", F.when(own, F.coalesce(F.col(until), F.col("now_ms"))).otherwise(F.col("until_ms"))).drop("preset").withColumnRenamed("_preset", preset)


def calendar_windows(now: DataFrame, offset_hours: Column) -> DataFrame:
    """Preset windows (since_ms, until_ms) per input row holding ``now_ms``.

    Local midnight uses a fixed offset in hours (no zone rules); a week starts
    on Sunday; ``until`` is min(period end, now); all time starts at 0.
    Expects columns ``now_ms`` and the offset; emits one row per preset.
    """
    off_ms = (offset_hours * F.lit(HOUR_MS)).cast("bigint")
    # local calendar date by integer arithmetic: no session-zone dependence
    d0 = F.date_from_unix_date(F.floor((F.col("now_ms") + off_ms) / F.lit(DAY_MS)).cast("int"))

    def ms_of(date_col: Column) -> Column:
        return F.unix_date(date_col).cast("bigint") * F.lit(DAY_MS) - off_ms

    month0 = F.trunc(d0, "month")
    year0 = F.trunc(d0, "year")
    week0 = F.date_sub(d0, F.dayofweek(d0) - 1)
    now_ms = F.col("now_ms")

    def row(name: str, since: Column, until: Column) -> Column:
        return F.struct(F.lit(name).alias("preset"), since.alias("since_ms"), until.alias("until_ms"))

    rows = F.array(
        row("today", ms_of(d0), now_ms),
        row("this_week", ms_of(week0), F.least(ms_of(F.date_add(week0, 7)), now_ms)),
        row("this_month", ms_of(month0), F.least(ms_of(F.add_months(month0, 1)), now_ms)),
        row("last_month", ms_of(F.add_months(month0, -1)), ms_of(month0)),
        row("this_year", ms_of(year0), now_ms),
        row("all_time", F.lit(0).cast("bigint"), now_ms),
    )
    return now.select("*", F.explode(rows).alias("_p")).select(
        "*", F.col("_p.preset").alias("preset"), F.col("_p.since_ms").alias("since_ms"),
        F.col("_p.until_ms").alias("until_ms"),
    ).drop("_p")
