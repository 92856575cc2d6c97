"""Structured Streaming jobs: raw append, hours and days from a stream, conflation, dedupe.

State lives in the sinks (parquet tables under a shared folder) and in the
streaming checkpoint, so a lost executor or a restarted driver resumes from
the last committed micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import DAY_MS, bucket, idiv
from ..operators import tiers, warmup
from ..operators.windows import prev_row
from ..sources import tier_store


#: Rows may be this late before their hour closes.
LATE = "2 hours"


def raw_append(stream: DataFrame, raw_dir: str, checkpoint: str, settings: DataFrame | None = None, trigger: dict | None = None):
    """Append the 1 s tier, partitioned by day, while recording is on.

    ``settings`` is the one-row settings view; it is a static side of the stream, read again for every micro-batch.
    """
    if settings is not None:
        stream = stream.crossJoin(F.broadcast(settings.where(F.col("enabled") == "true").select(F.lit(1).alias("_on")))).drop("_on")  # one row or none
    s = stream.withColumn("day", bucket(F.col("ts"), DAY_MS))
    w = s.writeStream.format("parquet").option("path", raw_dir).option("checkpointLocation", checkpoint).partitionBy("day")
    return w.trigger(**(trigger or {"availableNow": True})).start()


def _closed(stream: DataFrame, at: str, late: str, width: str, aggs: list) -> DataFrame:
    """One row per engine and window, once the watermark has passed the window's end."""
    timed = stream.withColumn("_time", F.timestamp_millis(at)).withWatermark("_time", late)
    done = timed.groupBy("engine_key", F.window("_time", width).alias("_w")).agg(*aggs)
    rows = done.withColumn("bucket_ts", F.unix_millis("_w.start")).select(*tiers.TIER_COLUMNS)
    return rows.withColumn("day", idiv(F.col("bucket_ts"), DAY_MS).cast("int"))


def hour_stream(raw: DataFrame, late: str = LATE) -> DataFrame:
    """Hours of a raw stream. Sums, counts and maxima wait as partial states, so a late row is merged, not read again."""
    return _closed(raw, "ts", late, "1 hour", tiers.hour_aggs())


def day_stream(hours: DataFrame) -> DataFrame:
    """Days of a stream of closed hours. Hours close in order, so no delay is needed; a day closes with its successor's first hour."""
    return _closed(hours, "bucket_ts", "0 seconds", "1 day", tiers.day_aggs())


def stream_rollup(spark: SparkSession, raw: DataFrame, folder: str, checkpoint: str, late: str = LATE, trigger: dict | None = None):
    """Raw stream -> ``folder/hour`` -> ``folder/day``, both append-only; returns the two running queries.

    The day query follows the files that the hour query has committed, so raw rows are read once and no closed
    hour or day is read or written again. With ``availableNow`` the first query ends before the second starts.
    Rows later than ``late`` are in the raw tier only; the batch rollup with ``upsert_replace`` includes them.
    Both restart from their checkpoints.
    """
    trigger = trigger or {"availableNow": True}

    def start(rows: DataFrame, tier: str):
        return (rows.writeStream.format("parquet").outputMode("append").partitionBy("day").option("path", f"{folder}/{tier}")
                .option("checkpointLocation", f"{checkpoint}/{tier}").trigger(**trigger).start())

    hours = start(hour_stream(raw, late), "hour")
    if trigger.get("availableNow"):
        hours.awaitTermination()
    schema = ", ".join(f"{c} {t}" for c, t in tier_store.TIERS["hour"][1]) + ", day int"
    return hours, start(day_stream(spark.readStream.schema(schema).parquet(f"{folder}/hour")), "day")


def conflate_latest(df: DataFrame, key: str, ts: str, every_ms: int = 2000, ties: tuple[str, ...] = ()) -> DataFrame:
    """Newest row per key per flush interval; the first row of each key also passes at once.

    ``ties`` orders rows of equal time. Both ends of an interval come from one
    aggregation; a key's first row is not repeated if it is its interval's newest.
    """
    b = bucket(F.col(ts), every_ms)
    row, at = F.struct(*df.columns), F.struct(ts, *ties)
    ends = df.groupBy(key, b.alias("_flush")).agg(F.max_by(row, at).alias("_new"), F.min_by(row, at).alias("_old"))
    first = ends.groupBy(key).agg(F.min_by(F.struct("_old", "_new"), "_flush").alias("_f")).where(~F.col("_f._old").eqNullSafe(F.col("_f._new")))
    return ends.select("_new.*").unionByName(first.select("_f._old.*"))


def conflate_stream(stream: DataFrame, key: str, event_time: str, every: str = "2 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Streaming form: 2 s tumbling windows with a watermark, newest row per key and window."""
    return (stream.withWatermark(event_time, watermark)
            .groupBy(key, F.window(event_time, every))
            .agg(F.max_by(F.struct(*stream.columns), F.col(event_time)).alias("latest")))


def tick_dedupe(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Drop a row whose timestamp equals the previous row's of the same key."""
    d = prev_row(df, key, ts, tie, [])
    return d.where(F.col(f"{ts}_lag").isNull() | (F.col(ts) != F.col(f"{ts}_lag"))).drop(f"{ts}_lag")


def tick_dedupe_stream(stream: DataFrame, keys: list[str], event_time: str, watermark: str = "10 seconds") -> DataFrame:
    """Streaming form: duplicates of (key, timestamp) dropped within the watermark."""
    return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(keys)


def warmup_stream(spark: SparkSession, polls: DataFrame, folder: str, checkpoint: str, counters: list[str], trigger_counter: str, skip: int = 1, trigger: dict | None = None):
    """Warm-up baselining of a stream of polls (engine_key, ts, seq, counters): rows to ``folder/rows``, states to ``folder/state``.

    A micro-batch goes through the batch relations, which begin with the engines' states after the batch before (one row
    per engine). Rows and states are written under the batch's number, so a batch that is run again replaces its own.
    Polls must arrive in time order across micro-batches; ``epoch`` is null where the baseline is from an earlier batch.
    """
    schema = "engine_key string, " + ", ".join(f"{n} {t}" for n, t in warmup.STATE.items())

    def step(batch: DataFrame, n: int) -> None:
        start = spark.read.schema(schema).parquet(f"{folder}/state/batch={n - 1}") if n else spark.createDataFrame([], schema)
        batch = batch.checkpoint()  # read by the fold and by the join
        args = (counters, trigger_counter, skip, "engine_key", "ts", "seq", start)
        ended = warmup.folded(batch, *args).drop("changes")
        idle = start.join(ended, "engine_key", "left_anti")
        ended.unionByName(idle).write.mode("overwrite").parquet(f"{folder}/state/batch={n}")
        warmup.baselined(batch, *args).write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    return polls.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(**(trigger or {"availableNow": True})).start()


LIVENESS_OUT = "engine_key string, event string, ts long"


def liveness_stream(probes_stream: DataFrame, event_time: str = "event_time", watermark: str = "1 minute") -> DataFrame:
    """Streaming liveness keyed by engine with an event-time timer.

    State: consecutive failures and the time the engine entered Stopped.
    Emits ``stopped`` at the third consecutive failure, ``recovered`` on the
    next success, and ``removed`` when the watermark passes 30 s after the
    stop without a recovery (strictly later, as in the batch operator).
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from ..operators.state import REMOVE_AFTER_MS, STOP_AFTER

    def fn(key, pdfs, gstate):
        engine = key[0]
        if gstate.hasTimedOut:
            fails, stopped_at = gstate.get
            gstate.remove()
            yield pd.DataFrame([(engine, "removed", int(stopped_at) + REMOVE_AFTER_MS + 1)], columns=["engine_key", "event", "ts"])
            return
        fails, stopped_at = gstate.get if gstate.exists else (0, None)
        stopped_at = None if stopped_at is None or pd.isna(stopped_at) else int(stopped_at)
        out = []
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "seq"])
        for r in rows.itertuples(index=False):
            if stopped_at is not None and int(r.ts) > stopped_at + REMOVE_AFTER_MS:
                # the engine was gone before this row came
                out.append((engine, "removed", stopped_at + REMOVE_AFTER_MS + 1))
                fails, stopped_at = 0, None
            if r.success:
                if stopped_at is not None:
                    out.append((engine, "recovered", int(r.ts)))
                fails, stopped_at = 0, None
            else:
                fails += 1
                if fails >= STOP_AFTER and stopped_at is None:
                    stopped_at = int(r.ts)
                    out.append((engine, "stopped", stopped_at))
        due = None if stopped_at is None else stopped_at + REMOVE_AFTER_MS + 1
        if due is not None and due <= gstate.getCurrentWatermarkMs():  # a timer must lie ahead of the watermark
            out.append((engine, "removed", due))
            fails, stopped_at, due = 0, None, None
        gstate.update((int(fails), stopped_at))
        if due is not None:
            gstate.setTimeoutTimestamp(due)
        yield pd.DataFrame(out, columns=["engine_key", "event", "ts"])

    return (probes_stream.withWatermark(event_time, watermark).groupBy("engine_key")
            .applyInPandasWithState(fn, LIVENESS_OUT, "fails long, stopped_at long", "append", GroupStateTimeout.EventTimeTimeout))
