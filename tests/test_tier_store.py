"""Stored tiers: layout, pruned reads, jobs that rewrite days, one-time changes with a marker."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.functions.timeutil import DAY_MS, HOUR_MS
from tessera.operators import history as H
from tessera.operators import tiers as T
from tessera.plans import world as W
from tessera.sources import tier_store as TS

D0 = 19_700  # a day number


def raw(spark, rows):
    """rows: (engine, ts, tokens, power)."""
    names = {"engine_key": 0, "ts": 1, "total_prompt_tokens": 2, "power_watts": 3}
    data = [tuple(r[names[c]] if c in names else None for c, _ in TS.TIERS["raw"][1]) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in TS.TIERS["raw"][1]))


def tier(spark, rows):
    """rows: (engine, bucket, tokens, power sum)."""
    names = {"engine_key": 0, "bucket_ts": 1, "total_prompt_tokens": 2, "power_watts_sum": 3}
    data = [tuple(r[names[c]] if c in names else None for c, _ in TS.TIERS["hour"][1]) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in TS.TIERS["hour"][1]))


@pytest.fixture
def folder(spark):
    out = tempfile.mkdtemp(prefix="tiers-")
    rows = [(f"e{k % 3}", (D0 + k % 5) * DAY_MS + 1000 * k, k, 1.5 * k) for k in range(300)]
    TS.write(raw(spark, rows), out, "raw")
    TS.write(tier(spark, rows), out, "hour")
    TS.write(tier(spark, rows), out, "day")
    return out


def keys(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_a_scan_prunes_days_and_pushes_engine_and_time(spark, folder):
    asked = [TS.Request(1, (D0 + 1) * DAY_MS, (D0 + 1) * DAY_MS + 200_000, "e1"), TS.Request(2, (D0 + 2) * DAY_MS, (D0 + 3) * DAY_MS, "e2")]
    got = TS.scan(spark, folder, "raw", asked).select("request_id", "engine_key", "ts", "power_watts")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    days = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    assert f">= {D0 + 1}" in days and f"<= {D0 + 3}" in days
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert "GreaterThanOrEqual(ts," in pushed and "In(engine_key, [e1,e2])" in pushed
    assert "ReadSchema: struct<engine_key:string,ts:bigint,power_watts:double>" in plan
    every = [(r[0], r[1]) for r in TS.read(spark, folder, "raw").select("engine_key", "ts").collect()]
    assert keys(got, "request_id", "engine_key", "ts") == sorted(
        ((q.id, e, t) for q in asked for e, t in every if e == q.engine_key and q.since_ms <= t <= q.until_ms), key=str)


def test_requests_may_overlap_and_name_no_engine(spark, folder):
    asked = [TS.Request(1, 0, D0 * DAY_MS + 10_000), TS.Request(2, D0 * DAY_MS, D0 * DAY_MS + 10_000, "e0"), TS.Request(3, 5, 4)]
    got = keys(TS.scan(spark, folder, "hour", asked), "request_id", "engine_key", "bucket_ts")
    rows = [(r[0], r[1]) for r in TS.read(spark, folder, "hour").select("engine_key", "bucket_ts").collect()]
    assert got == sorted(((q.id, e, t) for q in asked for e, t in rows if q.engine_key in (None, e) and q.since_ms <= t <= q.until_ms), key=str)


def test_files_are_sorted_and_a_hot_engines_day_is_spread(spark):
    out = tempfile.mkdtemp(prefix="tiers-")
    conf = "spark.sql.adaptive.enabled"
    spark.conf.set(conf, "false")
    try:
        TS.write(raw(spark, [("hot", D0 * DAY_MS + k, k, 1.0) for k in range(4000)]), out, "raw")
    finally:
        spark.conf.set(conf, "true")
    found = TS.read(spark, out, "raw").groupBy(F.input_file_name().alias("f")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    assert len(found) > 4 and max(r.n for r in found) < 2000
    assert all(x.b < y.a for x, y in zip(found, found[1:]))


@pytest.mark.parametrize("as_table", [False, True])
def test_windows_as_parameters_and_as_a_table(spark, folder, as_table):
    windows = [(1, 0, 2**60), (2, (D0 + 1) * DAY_MS, (D0 + 2) * DAY_MS), (3, D0 * DAY_MS + 50_000, D0 * DAY_MS + 60_000), (4, 7, 6), (5, (D0 + 2) * DAY_MS + 2000, (D0 + 2) * DAY_MS + 2000)]
    stored = TS.read(spark, folder, "raw")
    rows = [(r[0], r[1]) for r in stored.select("engine_key", "ts").collect()]
    for df in (stored, stored.drop("day")):
        got = H.in_windows(df, "ts", H.windows_df(spark, windows) if as_table else windows)
        assert keys(got, "window_id", "engine_key", "ts") == sorted(((w, e, t) for w, a, b in windows for e, t in rows if a <= t <= b), key=str)
        assert got.columns == [*df.columns, "window_id", "since_ms", "until_ms"]
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString().split("CartesianProduct")[0] or as_table


def test_purge_rewrites_the_touched_days_only(spark, folder):
    bad = [("e9", D0 * DAY_MS + 5, T.PURGE_LIMIT + 1, 1.0), ("e9", D0 * DAY_MS + 6, T.PURGE_LIMIT, 1.0), ("e9", (D0 + 40) * DAY_MS, 2 * T.PURGE_LIMIT, 1.0)]
    TS.write(raw(spark, bad), folder, "raw")
    TS.write(tier(spark, bad), folder, "day")
    files = lambda: {r[0] for r in TS.read(spark, folder, "raw").where(F.col("day") != D0).select(F.input_file_name()).distinct().collect() if f"day={D0 + 40}" not in r[0]}
    before = files()
    TS.purge(spark, folder)
    assert files() == before
    for name, at in (("raw", "ts"), ("day", "bucket_ts")):
        left = keys(TS.read(spark, folder, name).where("engine_key = 'e9'"), at, "total_prompt_tokens")
        assert left == [(D0 * DAY_MS + 6, T.PURGE_LIMIT)]
        assert TS.read(spark, folder, name).count() == 301
    assert D0 + 40 not in TS.days(spark, folder, "raw") + TS.days(spark, folder, "day")


def test_prune_drops_days_whole_and_cuts_one(spark, folder):
    cut = (D0 + 2) * DAY_MS + 150_000
    rows = [r[0] for r in TS.read(spark, folder, "raw").select("ts").collect()]
    counts = TS.prune(spark, folder, cut)
    assert counts == dict.fromkeys(TS.TIERS, sum(t < cut for t in rows))
    for name, (at, _) in TS.TIERS.items():
        assert sorted(r[0] for r in TS.read(spark, folder, name).select(at).collect()) == sorted(t for t in rows if t >= cut)
        assert TS.days(spark, folder, name) == [D0 + 2, D0 + 3, D0 + 4]
    assert TS.prune(spark, folder, cut) == dict.fromkeys(TS.TIERS, 0)


def test_backfill_runs_once_and_survives_an_interruption(spark, folder):
    target = tempfile.mkdtemp(prefix="tiers-") + "/new"
    TS.write(raw(spark, [("half", 5, 5, 5.0)]), target, "raw")  # an earlier run ended before its marker
    assert TS.backfill_power(spark, folder, target) == target
    old = {r[0]: r[1] for r in TS.read(spark, folder, "raw").select("ts", "power_watts").collect()}
    for _ in range(2):
        new = {r[0]: r[1] for r in TS.read(spark, target, "raw").select("ts", "power_watts").collect()}
        assert new == {t: 4 * p for t, p in old.items()}
        assert [tuple(r) for r in TS.markers(spark, target).collect()] == [("power_backfill_done", "4")]
        assert TS.backfill_power(spark, target, target + "-again") == target  # the marker says so
        assert TS.backfill_power(spark, folder, target) == target


def test_old_and_new_files_in_one_folder(spark):
    out = tempfile.mkdtemp(prefix="tiers-")
    row = tier(spark, [("a", 0, 1, 2.0)]).withColumn("kv_cache_pct_max", F.lit(7.0))
    TS.write(row.drop(*TS.ADDED["hour"]), out, "hour")
    TS.write(row.withColumn("bucket_ts", F.lit(HOUR_MS)), out, "hour")
    assert keys(TS.read(spark, out, "hour"), "bucket_ts", "kv_cache_pct_max", "power_watts_sum") == [(0, None, 2.0), (HOUR_MS, 7.0, 2.0)]


def test_an_empty_store(spark):
    out = tempfile.mkdtemp(prefix="tiers-")
    for name, make in (("raw", raw), ("hour", tier), ("day", tier)):
        TS.write(make(spark, []), out, name)
    TS.purge(spark, out)
    assert TS.prune(spark, out, 10**13) == dict.fromkeys(TS.TIERS, 0)
    assert TS.scan(spark, out, "raw", [TS.Request(1, 0, 10**13)]).collect() == []


def test_the_world_reads_its_tiers_from_the_store(spark):
    plan = W.hourly(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(bucket_ts," in plan and "Exchange" not in plan
