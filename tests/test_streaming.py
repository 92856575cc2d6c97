"""Streaming forms agree with their batch counterparts (file source, availableNow, final state)."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from tessera.functions.timeutil import DAY_MS
from tessera.plans import state_suite
from tessera.plans import world as W
from tessera.streaming import jobs as SJ

SF = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_warmup_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="warmup-stream-")
    inp = state_suite.warmup_input(spark, SF)
    src = os.path.join(base, "src")
    edges = [0, W.NOW_MS - 20 * DAY_MS, W.NOW_MS - 9 * DAY_MS, 2**62]
    for a, b in zip(edges, edges[1:]):  # a file for each part of the time, so the stream sees the polls in order
        inp.where((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    stream = spark.readStream.schema(inp.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = SJ.warmup_stream(spark, stream, base, os.path.join(base, "ck"), state_suite.COUNTERS, state_suite.TRIGGER)
    q.awaitTermination()
    cols = ["engine_key", "ts", "seq", "warming_up", "just_transitioned", *[f"adj_{c}" for c in state_suite.COUNTERS]]
    got = _rows(spark.read.parquet(f"{base}/rows"), cols)
    assert got == _rows(state_suite.warmed(spark, SF), cols)
    assert spark.read.parquet(f"{base}/state").select("batch").distinct().count() == 3


def test_dedupe_and_conflate_stream(spark):
    base = tempfile.mkdtemp(prefix="dedupe-stream-")
    raw = W.raw(spark, SF).select("engine_key", "ts", "power_watts")
    raw = raw.withColumn("event_time", F.timestamp_millis(F.col("ts") - F.col("ts") % 1000))
    src = os.path.join(base, "src")
    raw.union(raw).repartition(3).write.parquet(src)  # every tick twice
    stream = spark.readStream.schema(raw.schema).parquet(src)
    q = (SJ.tick_dedupe_stream(stream, ["engine_key", "event_time"], "event_time").writeStream.format("parquet")
         .option("path", os.path.join(base, "dd")).option("checkpointLocation", os.path.join(base, "ck1"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    dd = spark.read.parquet(os.path.join(base, "dd"))
    assert dd.count() == raw.select("engine_key", "event_time").distinct().count()
    q = (SJ.conflate_stream(stream, "engine_key", "event_time").select("engine_key", "window.start", "latest.ts")
         .writeStream.format("parquet").option("path", os.path.join(base, "cf"))
         .option("checkpointLocation", os.path.join(base, "ck2")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    cf = spark.read.parquet(os.path.join(base, "cf"))
    # every closed 2 s window keeps exactly its newest tick
    want = raw.groupBy("engine_key", F.window("event_time", "2 seconds").start.alias("start")).agg(F.max("ts").alias("ts"))
    got = set(_rows(cf, ["engine_key", "start", "ts"]))
    assert got and got <= set(_rows(want, ["engine_key", "start", "ts"]))


def test_liveness_stream_stops_like_batch(spark):
    from tessera.operators import state as ST
    from tessera.sources import fixtures as fx

    base = tempfile.mkdtemp(prefix="liveness-stream-")
    probes = fx.view(spark, SF, "probes").select("engine_key", "ts", "seq", "success")
    probes = probes.withColumn("event_time", F.timestamp_millis("ts")).withColumn("day", F.floor(F.col("ts") / DAY_MS))
    src = os.path.join(base, "src")
    for (d,) in probes.select("day").distinct().orderBy("day").collect():
        probes.where(F.col("day") == d).drop("day").coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.01)
    stream = spark.readStream.schema(probes.drop("day").schema).option("maxFilesPerTrigger", 2).parquet(src)
    out = os.path.join(base, "out")
    q = (SJ.liveness_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(base, "ck")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    ev = spark.read.parquet(out)
    got = set(_rows(ev.where("event = 'stopped'"), ["engine_key", "ts"]))
    batch = ST.failure_streak(probes.drop("day", "event_time")).where(F.col("streak") == 3)
    want = set(_rows(batch.select("engine_key", F.col("stopped_at").alias("ts")), ["engine_key", "ts"]))
    assert got == want and got
    # every removal comes strictly more than 30 s after a stop of the same engine
    rem = _rows(ev.where("event = 'removed'"), ["engine_key", "ts"])
    stops = {}
    for k, t in got:
        stops.setdefault(k, []).append(t)
    assert all(any(t - s > 30_000 for s in stops[k]) for k, t in rem)


def test_liveness_stream_survives_late_failures(spark):
    """A failure after the watermark has passed the removal time must not set a timer in the past."""
    base = tempfile.mkdtemp(prefix="liveness-late-")
    src, t0 = os.path.join(base, "src"), 1_700_000_000_000
    steps = [[(t0 + i * 1000, i, i == 0) for i in range(5)], [(t0 + 3_600_000, 5, True)], [(t0 + 3_600_000 + i * 1000, 5 + i, False) for i in range(1, 5)],
             [(t0 + 9_000_000, 20, False), (t0 + 9_001_000, 21, True)], [(t0 + 9_300_000, 22, True)]]
    schema = "engine_key string, ts long, seq long, success boolean"
    for rows in steps:
        df = spark.createDataFrame([("e", *r) for r in rows], schema).withColumn("event_time", F.timestamp_millis("ts"))
        df.coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.01)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = os.path.join(base, "out")
    q = (SJ.liveness_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(base, "ck")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None
    got = sorted((r.ts - t0, r.event) for r in spark.read.parquet(out).collect())
    assert got == [(3_000, "stopped"), (33_001, "removed"), (3_603_000, "stopped"), (3_633_001, "removed")]


def test_hours_and_days_of_a_stream_equal_the_batch(spark):
    """Late rows reach their hour; raw, hours and days equal the batch; each tier goes on from its checkpoint."""
    from tessera.operators import tiers as T
    from tessera.plans import streaming_suite as SS
    from tessera.plans.registry import normalise
    from tessera.sources import tier_store as TS

    base = tempfile.mkdtemp(prefix="stream-tiers-")
    raw = W.raw(spark, SF)
    raw.limit(0).write.parquet(f"{base}/feed")
    stream = spark.readStream.schema(raw.schema).parquet(f"{base}/feed")
    late = 0
    for k, rows in enumerate(SS.slices(raw)):
        if k:  # rows that belong before what has been seen
            late += rows.where(F.col("ts") < SS.SLICES[k - 1]).count()
        rows.write.mode("append").parquet(f"{base}/feed")
        SJ.raw_append(stream, f"{base}/raw", f"{base}/ck-raw").awaitTermination()
        for q in SJ.stream_rollup(spark, stream, base, f"{base}/ck"):
            q.awaitTermination()
    assert late > 0
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(raw, spark.read.schema(raw.schema).parquet(f"{base}/raw"))
    rounded = lambda df: normalise(df.drop("day"))
    hours = T.rollup_1h(raw, W.NOW_MS)
    assert same(rounded(hours), rounded(TS.read(spark, base, "hour").where(F.col("bucket_ts") < W.HOUR_CUT)))
    assert same(rounded(T.rollup_1d(hours, W.NOW_MS)), rounded(TS.read(spark, base, "day").where(F.col("bucket_ts") < W.DAY_CUT)))


def test_recording_gate(spark):
    base = tempfile.mkdtemp(prefix="gate-")
    raw = spark.createDataFrame([("a", k) for k in range(6)], "engine_key string, ts long")
    raw.limit(0).write.parquet(f"{base}/feed")
    stream = spark.readStream.schema(raw.schema).parquet(f"{base}/feed")
    for k, on in enumerate(["true", "false", "true"]):
        raw.where(F.col("ts") % 3 == k).write.mode("append").parquet(f"{base}/feed")
        view = spark.createDataFrame([(on,)], "enabled string")
        SJ.raw_append(stream, f"{base}/raw", f"{base}/ck", view).awaitTermination()
    assert sorted(r.ts for r in spark.read.parquet(f"{base}/raw").collect()) == [0, 2, 3, 5]
