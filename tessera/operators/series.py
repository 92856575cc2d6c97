"""Series operators on long ``(key..., timestamp_ms, value)`` tables.

Per-series statistics that need the whole series (mean line, latest point)
are computed as a ``groupBy`` (partial aggregation, skew-safe) and joined
back, not as an unbounded window. Bounded row frames (trend, sparkline) run
as windows per series over rollup tiers, whose series length is bounded by
the number of buckets, not by raw row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import prev_non_null


def series_mean_line(points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Every point replaced by the mean of all points of its series."""
    means = points.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return points.join(means, keys, "inner").withColumn(value, F.col("_mean")).drop("_mean")


def trend(points: DataFrame, keys: list[str], ts: str = "timestamp_ms", value: str = "value",
          threshold: float = 0.05) -> DataFrame:
    """Trend as of each point: mean of the last 3 vs mean of the up to 12 before them.

    Fewer than 6 points or fewer than 3 older ones -> stable; older mean 0 ->
    up when the recent mean is > 0; otherwise +-threshold of |older|.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    recent = w.rowsBetween(-2, 0)
    older = w.rowsBetween(-14, -3)
    d = points.select(
        "*",
        F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_n"),
        F.avg(value).over(recent).alias("_ra"),
        F.avg(value).over(older).alias("_oa"),
        F.count(F.lit(1)).over(older).alias("_on"),
    )
    change = (F.col("_ra") - F.col("_oa")) / F.abs(F.col("_oa"))
    t = (
        F.when((F.col("_n") < 6) | (F.col("_on") < 3), "stable")
        .when(F.col("_oa") == 0, F.when(F.col("_ra") > 0, "up").otherwise("stable"))
        .when(change > threshold, "up")
        .when(change < -threshold, "down")
        .otherwise("stable")
    )
    return d.withColumn("trend", t).drop("_n", "_ra", "_oa", "_on")


def trend_spark(points: DataFrame, keys: list[str], ts: str = "timestamp_ms", value: str = "value") -> DataFrame:
    """Current value vs the mean of the (up to) 5 points before it, x1.05 / x0.95."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-5, -1)
    avg = F.avg(value).over(w)
    t = (
        F.when(avg.isNull(), "stable")
        .when(F.col(value) > avg * 1.05, "up")
        .when(F.col(value) < avg * 0.95, "down")
        .otherwise("stable")
    )
    return points.withColumn("trend", t)


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Last ``n`` rows per key (newest first by ``order``).

    ``row_number() <= n`` lets Spark insert a WindowGroupLimit, so each map
    task keeps only its local top ``n`` per key before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def downsample_stride(points: DataFrame, keys: list[str], max_points: int, ts: str = "timestamp_ms") -> DataFrame:
    """If a series has n > max points keep rows 0, s, 2s, ... (s = ceil(n/max)) plus the last row."""
    w = Window.partitionBy(*keys).orderBy(ts)
    d = points.withColumn("_i", F.row_number().over(w) - 1).join(
        points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "inner"
    )
    s = F.ceil(F.col("_n") / F.lit(max_points))
    keep = (F.col("_n") <= max_points) | (F.col("_i") % s == 0) | (F.col("_i") == F.col("_n") - 1)
    return d.where(keep).drop("_i", "_n")


def pad_left(points: DataFrame, keys: list[str], max_points: int, ts: str = "timestamp_ms",
             value: str = "value") -> DataFrame:
    """If a series has n < max points, prepend max-n points spaced like its first gap.

    The spacing is ts[1] - ts[0] (1000 ms for a single point); the padding
    carries the first value. Generated with ``sequence`` per series.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    firsts = (
        points.withColumn("_i", F.row_number().over(w))
        .where(F.col("_i") <= 2)
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("_i") == 1, F.col(ts))).alias("_t0"),
            F.min(F.when(F.col("_i") == 2, F.col(ts))).alias("_t1"),
            F.first(F.when(F.col("_i") == 1, F.col(value)), ignorenulls=True).alias("_v0"),
        )
    )
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    f = firsts.join(counts, keys).where(F.col("_n") < max_points)
    interval = F.coalesce(F.col("_t1") - F.col("_t0"), F.lit(1000).cast("bigint"))
    pads = f.select(
        *keys, F.explode(F.sequence(F.lit(1), F.lit(max_points) - F.col("_n"))).alias("_k"), "_t0", "_v0", interval.alias("_iv")
    ).select(*keys, (F.col("_t0") - F.col("_k") * F.col("_iv")).alias(ts), F.col("_v0").alias(value))
    return points.select(*keys, ts, value).unionByName(pads)


def pad_data(points: DataFrame, keys: list[str], max_points: int, ts: str = "timestamp_ms", value: str = "value") -> DataFrame:
    """Chart padding: downsample when longer than ``max_points``, left-pad when shorter."""
    # a series is either longer (downsampled) or shorter (padded to exactly max)
    return downsample_stride(pad_left(points, keys, max_points, ts, value), keys, max_points, ts)


def series_merge(points: DataFrame, keys: list[str], series_col: str, series_ids: list, ts: str = "timestamp_ms",
                 value: str = "value") -> DataFrame:
    """N series -> one row per (keys, ts) with columns s0..sN-1 (null where a series has no point)."""
    g = points.groupBy(*keys, ts).pivot(series_col, series_ids).agg(F.first(value))
    return g.select(*keys, ts, *[F.col(f"`{sid}`").alias(f"s{i}") for i, sid in enumerate(series_ids)])


def series_sum(a: DataFrame, b: DataFrame, keys: list[str], ts: str = "timestamp_ms", value: str = "value",
               order: str | None = None) -> DataFrame:
    """Sum of two series by timestamp, one row each; a missing side counts 0.

    Of repeated timestamps the first series gives its last point (by ``order``;
    the largest value where no order is given) and the second all its points.
    """
    last = F.max_by(value, order) if order else F.max(value)
    both = a.groupBy(*keys, ts).agg(last.alias(value)).unionByName(b.select(*keys, ts, value))
    return both.groupBy(*keys, ts).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def per_request_rate(tps: DataFrame, reqs: DataFrame, key: str, ts: str = "timestamp_ms", value: str = "value") -> DataFrame:
    """Throughput / active requests at the same time, else at the nearest time.

    Nearest is found with two as-of lookups on the union of both series
    (previous-or-equal and next-or-equal request point), never a cross join;
    equal gaps pick the earlier point. No request data for the key -> 0;
    requests <= 0 -> 0.
    """
    u = tps.select(key, ts, F.col(value).alias("_tps"), F.lit(None).cast("double").alias("_rq"), F.lit(1).alias("_k")).unionByName(
        reqs.select(key, ts, F.lit(None).cast("double").alias("_tps"), F.col(value).cast("double").alias("_rq"), F.lit(0).alias("_k"))
    )
    # request points sort before throughput points at the same ts (tie 0 < 1)
    u = u.withColumn("_rqp", F.when(F.col("_k") == 0, F.struct(F.col(ts).alias("t"), F.col("_rq").alias("v"))))
    back = prev_non_null(u, key, ts, "_k", ["_rqp"], suffix="_b")
    fwd = back.withColumn("_nts", -F.col(ts))
    fwd = prev_non_null(fwd, key, "_nts", "_k", ["_rqp"], suffix="_f").drop("_nts")
    has_req = reqs.select(key).distinct().withColumn("_has", F.lit(True))
    d = fwd.where(F.col("_k") == 1).join(has_req, key, "left")
    b, f = F.col("_rqp_b"), F.col("_rqp_f")
    gb = F.col(ts) - b.getField("t")
    gf = f.getField("t") - F.col(ts)
    req = F.when(b.isNull(), f.getField("v")).when(f.isNull(), b.getField("v")).when(gf < gb, f.getField("v")).otherwise(b.getField("v"))
    out = F.when(F.col("_has").isNull(), F.lit(0.0)).when(req > 0, F.col("_tps") / req).otherwise(F.lit(0.0))
    return d.select(key, ts, out.alias(value))
