"""Keyed state over ordered polls: failure streaks, liveness, staleness.

Streaks are relational: one chunked window pass and what the chunks'
summaries carry into each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import DAY_MS, idiv
from .windows import next_row_ts

STOP_AFTER = 3          # fixed value: consecutive failures before Stopped
REMOVE_AFTER_MS = 30_000  # fixed value: Stopped engines are removed after 30 s (strict >)
STALE_MS = 5_000        # fixed value: a stream is stale after 5 s without a message


def failure_streak(probes: DataFrame, key: str = "engine_key", ts: str = "ts", tie: str = "seq",
                   chunk_ms: int = DAY_MS) -> DataFrame:
    """Consecutive failures since the last success; ``stopped`` at >= 3 with the time of the third failure.

    One window pass over (key, chunk) gives each row its streak within the
    chunk. A chunk's summary holds its closing streak and the times of its
    first failures; from the summaries in order follows what a streak brings
    into each chunk, and that is joined back.
    """
    cols = probes.columns
    w = Window.partitionBy(key, "_chunk").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    d = probes.withColumn("_chunk", idiv(F.col(ts), chunk_ms)).withColumn("_run", F.sum(F.when(F.col("success"), 0).otherwise(1)).over(w))
    d = d.withColumn("_at_ok", F.last(F.when(F.col("success"), F.col("_run")), ignorenulls=True).over(w))
    # open: no success in the chunk yet, so a streak from before goes on
    d = d.withColumn("_open", F.col("_at_ok").isNull()).withColumn("_n", F.col("_run") - F.coalesce("_at_ok", F.lit(0)))
    d = d.withColumn("_third", F.last(F.when((F.col("_n") == STOP_AFTER) & ~F.col("success"), F.col(ts)), ignorenulls=True).over(w))

    first = [F.min(F.when(F.col("_open") & (F.col("_n") == i), F.col(ts))).alias(f"_t{i}") for i in range(1, STOP_AFTER + 1)]
    last = F.max_by(F.struct(F.col("_n").alias("n"), F.col("_third").alias("third"), F.col("_open").alias("open")), F.struct(ts, tie)).alias("_end")
    c = d.groupBy(key, "_chunk").agg(last, *first)
    order = Window.partitionBy(key).orderBy("_chunk")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_cum", F.sum("_end.n").over(upto))
    c = c.withColumn("_base", F.when(~F.col("_end.open"), F.col("_cum") - F.col("_end.n")))
    brought = F.coalesce(F.max("_cum").over(before), F.lit(0)) - F.coalesce(F.last("_base", ignorenulls=True).over(before), F.lit(0))
    c = c.withColumn("_in", brought)
    # the third failure of a streak that was brought in, if it lies among the chunk's first failures
    lead = F.coalesce(*[F.when(F.col("_in") == STOP_AFTER - i, F.col(f"_t{i}")) for i in range(1, STOP_AFTER + 1)])
    c = c.withColumn("_lead", lead).withColumn("_closing", F.when(F.col("_end.open"), F.col("_lead")).otherwise(
        F.when(F.col("_end.n") >= STOP_AFTER, F.col("_end.third"))))
    c = c.withColumn("_carried", F.last("_closing", ignorenulls=True).over(before)).select(key, "_chunk", "_in", "_lead", "_carried")

    d = d.join(c, [key, "_chunk"])
    streak = F.col("_n") + F.when(F.col("_open"), F.col("_in")).otherwise(0)
    stopped_at = F.when(F.col("_open"), F.when(F.col("_in") >= STOP_AFTER, F.col("_carried")).otherwise(F.col("_lead"))).otherwise(F.col("_third"))
    d = d.withColumn("streak", streak.cast("bigint")).withColumn("stopped", F.col("streak") >= STOP_AFTER)
    return d.withColumn("stopped_at", F.when(F.col("stopped"), stopped_at)).select(*cols, "streak", "stopped", "stopped_at")


def liveness(streaks: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds ``removed``: the engine has been Stopped for more than 30 s at this poll."""
    return streaks.withColumn(
        "removed", F.coalesce(F.col("stopped") & ((F.col(ts) - F.col("stopped_at")) > REMOVE_AFTER_MS), F.lit(False)))


def staleness(df: DataFrame, key: str, ts: str = "ts", tie: str = "seq", stale_ms: int = STALE_MS) -> DataFrame:
    """Gaps after which the stream went stale: rows whose next message came more than ``stale_ms`` later."""
    d = next_row_ts(df, key, ts, tie, out="next_ts")
    return d.where(F.col("next_ts") - F.col(ts) > stale_ms).withColumn("gap_ms", F.col("next_ts") - F.col(ts))


def status_effective(probe_status: Column, success: Column, stopped: Column) -> Column:
    """Reported status: the probe's own status on success, else the state machine's.

    The state machine starts Running, becomes Running on every success and
    Stopped from the third consecutive failure on, so a failed probe reports
    Stopped at a streak >= 3 and Running before that.
    """
    return F.when(success, probe_status).when(stopped, F.lit("Stopped")).otherwise(F.lit("Running"))
