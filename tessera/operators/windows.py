"""Skew-safe ordered window helpers.

A window partitioned by an engine key alone sends all of that engine's rows
to one task; if one engine holds a third of the data that task dominates.
These helpers partition by (key, chunk of time) instead. What crosses a
chunk's boundary is carried through summaries on two levels: one row per
(key, chunk), scanned within its day, and one row per (key, day), scanned
over the days. So no group grows with a key's history, and the largest group
of rows is what one key has in one chunk, whatever the key's share.

The summaries come from partial aggregates, a second read of the input's
own columns. They are joined on (key, chunk), the partitioning that the
window has anyway. Since each helper reads its input twice, a chain of
them wants its lineage cut in between (``checkpoint()``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.timeutil import DAY_MS, idiv

#: Width of a chunk: 3,600 rows of a key that reports every second. A key with denser rows wants a narrower one.
CHUNK_MS = 3_600_000


def _chunk(ts: str, chunk_ms: int) -> Column:
    return idiv(F.col(ts), chunk_ms)


def _before(key: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _after(key: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)


def carried(summ: DataFrame, key: str, cols: list[str], chunk_ms: int, total: Callable[[str, str], Column],
            scan: Callable[[str, WindowSpec], Column], join: Callable[[Column, Column], Column], side=_before) -> DataFrame:
    """(key, _chunk, ``<col>_carry``): ``cols`` of all earlier chunks of the key together (``side``: or of all later ones).

    ``total(col, order)`` sums a day up, ``scan(col, window)`` sums up the rows of a window, and ``join(near, far)``
    puts the carry within the day and that of the other days together; null means that there is none.
    """
    w = side([key, "_day"], "_chunk")
    near = summ.withColumn("_day", idiv(F.col("_chunk") * F.lit(chunk_ms), DAY_MS)).select(
        key, "_day", "_chunk", *cols, *[scan(c, w).alias(f"{c}_near") for c in cols])
    # One row per day with its chunks (at most a day's), so the summaries are one chain and no side of a join.
    days = near.groupBy(key, "_day").agg(*[total(c, "_chunk").alias(c) for c in cols], F.collect_list(F.struct("_chunk", *[f"{c}_near" for c in cols])).alias("_chunks"))
    w = side([key], "_day")
    far = days.select(F.col(key).alias("_key"), "_chunks", *[scan(c, w).alias(f"{c}_far") for c in cols])
    both = far.select("_key", F.explode("_chunks").alias("_near"), *[f"{c}_far" for c in cols])
    return both.select("_key", F.col("_near._chunk").alias("_at"), *[join(F.col(f"_near.{c}_near"), F.col(f"{c}_far")).alias(f"{c}_carry") for c in cols])


def _with_carry(d: DataFrame, carry: DataFrame, key: str) -> DataFrame:
    """The carry of each row's chunk. Null keys and times match; rows without a time come first in their key's order."""
    return d.join(carry, F.col(key).eqNullSafe(F.col("_key")) & F.col("_chunk").eqNullSafe(F.col("_at"))).drop("_key", "_at")


def _last_total(c: str, order: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))


def _last_scan(c: str, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w)


def prev_non_null(df: DataFrame, key: str, ts: str, tie: str, cols: list[str], chunk_ms: int = CHUNK_MS,
                  suffix: str = "_prev", with_ts: bool = False) -> DataFrame:
    """For each row, the last non-null value of each column over strictly earlier rows of its key.

    Order is (ts, tie). With ``with_ts`` the timestamp of that value is added
    as ``<col><suffix>_ts``.
    """
    d = df.withColumn("_chunk", _chunk(ts, chunk_ms))
    st = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(tie).alias("s"), F.col(c).alias("v"))) for c in cols}
    w_in = Window.partitionBy(key, "_chunk").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    summ = d.groupBy(key, "_chunk").agg(
        *[F.max_by(st[c], F.when(F.col(c).isNotNull(), F.struct(F.col(ts), F.col(tie)))).alias(f"_{c}") for c in cols])
    carry = carried(summ, key, [f"_{c}" for c in cols], chunk_ms, _last_total, _last_scan, F.coalesce)
    for c in cols:
        d = d.withColumn(f"_{c}_in", F.last(st[c], ignorenulls=True).over(w_in))
    d = _with_carry(d, carry, key)
    out_cols = []
    for c in cols:
        prev = F.coalesce(F.col(f"_{c}_in"), F.col(f"_{c}_carry"))
        out_cols.append(prev.getField("v").alias(f"{c}{suffix}"))
        if with_ts:
            out_cols.append(prev.getField("t").alias(f"{c}{suffix}_ts"))
    return d.select("*", *out_cols).drop("_chunk", *[f"_{c}_{s}" for c in cols for s in ("in", "carry")])


def prev_row(df: DataFrame, key: str, ts: str, tie: str, cols: list[str], chunk_ms: int = CHUNK_MS,
             suffix: str = "_lag") -> DataFrame:
    """Plain ``lag(col, 1)`` over (key order by ts, tie), nulls included, skew-safe.

    The previous row of a chunk's first row is the last row of the nearest
    earlier non-empty chunk.
    """
    d = df.withColumn("_chunk", _chunk(ts, chunk_ms))
    w = Window.partitionBy(key, "_chunk").orderBy(ts, tie)
    row = F.struct(F.col(ts).alias("_t"), *[F.col(c).alias(c) for c in cols])
    summ = d.groupBy(key, "_chunk").agg(F.max_by(row, F.struct(F.col(ts), F.col(tie))).alias("_row"))
    carry = carried(summ, key, ["_row"], chunk_ms, _last_total, _last_scan, F.coalesce)
    d = _with_carry(d.withColumn("_lag", F.lag(row, 1).over(w)), carry, key)
    st = F.coalesce(F.col("_lag"), F.col("_row_carry"))
    outs = [st.getField(c).alias(f"{c}{suffix}") for c in cols] + [st.getField("_t").alias(f"{ts}{suffix}")]
    return d.select("*", *outs).drop("_chunk", "_lag", "_row_carry")


def next_row_ts(df: DataFrame, key: str, ts: str, tie: str, chunk_ms: int = CHUNK_MS, out: str = "next_ts") -> DataFrame:
    """``lead(ts, 1)`` over (key order by ts, tie), skew-safe (mirror of ``prev_row``)."""
    d = df.withColumn("_chunk", _chunk(ts, chunk_ms))
    w = Window.partitionBy(key, "_chunk").orderBy(ts, tie)
    summ = d.groupBy(key, "_chunk").agg(F.min(ts).alias("_first"))
    carry = carried(summ, key, ["_first"], chunk_ms, lambda c, _: F.min(c), lambda c, w: F.min(c).over(w), F.coalesce, _after)
    d = _with_carry(d.withColumn("_lead", F.lead(ts, 1).over(w)), carry, key)
    return d.withColumn(out, F.coalesce("_lead", "_first_carry")).drop("_chunk", "_lead", "_first_carry")


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def running_total(df: DataFrame, key: str, ts: str, tie: str, cols: list[str], chunk_ms: int = CHUNK_MS,
                  suffix: str = "_run") -> DataFrame:
    """Cumulative ``sum`` (nulls skipped) over (key order by ts, tie), skew-safe. Integer columns stay exact."""
    d = df.withColumn("_chunk", _chunk(ts, chunk_ms))
    w = Window.partitionBy(key, "_chunk").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    summ = d.groupBy(key, "_chunk").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    carry = carried(summ, key, [f"_{c}" for c in cols], chunk_ms, lambda c, _: F.sum(c), lambda c, w: F.sum(c).over(w), _plus)
    for c in cols:
        d = d.withColumn(f"_{c}_in", F.sum(c).over(w))
    d = _with_carry(d, carry, key)
    outs = [_plus(F.col(f"_{c}_in"), F.col(f"_{c}_carry")).alias(f"{c}{suffix}") for c in cols]
    return d.select("*", *outs).drop("_chunk", *[f"_{c}_{s}" for c in cols for s in ("in", "carry")])


def sliding_max(df: DataFrame, keys: list[str], ts: str, value: str, span_ms: int, out: str) -> DataFrame:
    """``out``: the largest non-null ``value`` of the key's rows with a time in [ts - span, ts].

    Time is cut into blocks as wide as the span, so a range reaches at most into the block before. Its part in the own
    block is a running maximum from the block's beginning; its part in the block before is a running maximum from
    that block's end, looked up at the range's first time. Each row is handled twice, however many rows a range holds,
    and the largest group is what one key has in two blocks.
    """
    at = F.col(ts)
    w = Window.partitionBy(*keys, "_block").orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, "_block").orderBy(F.desc(ts)).rangeBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_block", F.floor(at / F.lit(span_ms)).cast("bigint"))
    d = d.withColumn("_head", F.max(value).over(w)).withColumn("_tail", F.max(value).over(back))
    row = F.struct(*df.columns)
    # A row asks about its range's first time, and answers the next block's rows.
    asks = F.struct(F.col("_block").alias("block"), (at - F.lit(span_ms)).alias("time"), F.lit(1).alias("kind"), F.col("_head").alias("most"), row.alias("row"))
    answers = F.struct((F.col("_block") + 1).alias("block"), at.alias("time"), F.lit(0).alias("kind"), F.col("_tail").alias("most"), F.when(F.lit(False), row).alias("row"))
    both = d.select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode(F.array(asks, answers)).alias("_x")).select(*[f"_{k}" for k in keys], "_x.*")
    seen = Window.partitionBy(*[f"_{k}" for k in keys], "block").orderBy(F.desc("time"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    tail = F.last(F.when(F.col("kind") == 0, F.col("most")), ignorenulls=True).over(seen)
    return both.withColumn("_tail", tail).where("kind = 1").select("row.*", F.greatest("most", "_tail").alias(out))


# Named trailing windows in milliseconds.
TRAILING = {"5m": 300_000, "10m": 600_000, "15m": 900_000}


def trailing(rows: DataFrame, clock: DataFrame, keys: list[str], at: str, tick: str = "ts", spans: dict[str, int] | None = None) -> DataFrame:
    """(span, the row): rows with ``at`` >= the latest ``tick`` of their key's clock - span, for every span they fit.

    The clock is the key's snapshot stream: points, events and requests (by their end) are cut at the same time.
    Rows of a key without a tick are in no window; a row may lie after the latest tick.
    """
    spans = spans or TRAILING
    latest = clock.groupBy(*keys).agg(F.max(tick).alias("_latest"))
    named = F.array_compact(F.array(*[F.when(F.col(at) >= F.col("_latest") - F.lit(ms), F.lit(name)) for name, ms in spans.items()]))
    widest = F.col(at) >= F.col("_latest") - F.lit(max(spans.values()))
    return rows.join(latest, keys).where(widest).select(F.explode(named).alias("span"), *rows.columns)
