"""Skew-safe ordered helpers equal a plain whole-history window on a skewed input.

One engine holds more than a third of all rows across many days; the chunked
helpers (partitioned by (key, chunk) with carries on two levels) must give the
same answers as an unchunked window over each engine's full history.
"""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import windows as WD
from tessera.operators.windows import prev_non_null, prev_row, running_total


def _skewed(spark):
    day = 86_400_000
    rows = []
    for i in range(3000):
        hot = i % 2 == 0                      # half of all rows on one engine
        key = "hot" if hot else f"e{i % 7}"
        ts = (i * 7919) % (20 * day)          # spread over 20 days, unordered
        v = None if i % 5 == 0 else float(i % 97)
        rows.append((key, ts, i, v))
    return spark.createDataFrame(rows, "k string, ts long, seq long, v double")


def test_chunked_helpers_match_plain_windows(spark):
    df = _skewed(spark)
    w_prev = Window.partitionBy("k").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    w_run = Window.partitionBy("k").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "k", "ts", "seq",
        F.last("v", ignorenulls=True).over(w_prev).alias("prev_nn"),
        F.lag("v").over(Window.partitionBy("k").orderBy("ts", "seq")).alias("lag_v"),
        F.sum("v").over(w_run).alias("run_v"),
    )
    got = prev_non_null(df, "k", "ts", "seq", ["v"], suffix="_p")
    got = prev_row(got, "k", "ts", "seq", ["v"])
    got = running_total(got, "k", "ts", "seq", ["v"])
    got = got.select("k", "ts", "seq", F.col("v_p").alias("prev_nn"), F.col("v_lag").alias("lag_v"), F.col("v_run").alias("run_v"))
    a = sorted(tuple(r) for r in want.collect())
    b = sorted(tuple(r) for r in got.collect())
    assert len(a) == len(b) == 3000
    for x, y in zip(a, b):
        assert x[:5] == y[:5]
        assert (x[5] is None and y[5] is None) or abs(x[5] - y[5]) < 1e-6


def test_next_rows_match_plain_windows(spark):
    df = _skewed(spark)
    want = df.select("k", "ts", "seq", F.lead("ts").over(Window.partitionBy("k").orderBy("ts", "seq")).alias("n"))
    got = WD.next_row_ts(df, "k", "ts", "seq").select("k", "ts", "seq", F.col("next_ts").alias("n"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_one_key_on_one_day_is_divided(spark):
    """A third of all rows on one key, all on one day: no group of the ordered windows holds more than one chunk of it."""
    rows = [("hot" if i % 3 == 0 else f"e{i % 50}", (i * 28_800) % 86_400_000, i, float(i)) for i in range(9000)]
    df = spark.createDataFrame(rows, "k string, ts long, seq long, v double")
    groups = df.groupBy("k", WD._chunk("ts", WD.CHUNK_MS)).count().where("k = 'hot'")
    assert groups.count() == 24 and groups.agg(F.max("count")).first()[0] <= 3000 / 24 + 1
    got = running_total(df, "k", "ts", "seq", ["v"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_chunk" in plan
    w = Window.partitionBy("k").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    a = {r.seq: r.v_run for r in got.collect()}
    assert a == {r.seq: r.x for r in df.select("seq", F.sum("v").over(w).alias("x")).collect()}


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 5, 0, 1.0), (None, 10**9, 1, None), ("a", 7, 2, 2.0)], "k string, ts long, seq long, v double")
    got = {r.seq: r.v_prev for r in prev_non_null(df, "k", "ts", "seq", ["v"]).collect()}
    assert got == {0: None, 1: 1.0, 2: None}


@pytest.mark.parametrize("span", [1, 250, 10_000])
def test_sliding_maximum_matches_a_range_frame(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice(["x", "y"]), rng.randint(-3000, 6000), None if rng.random() < 0.2 else rng.randint(0, 99) / 4, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, g string, ts long, v double, seq long")
    w = Window.partitionBy("k", "g").orderBy("ts").rangeBetween(-span, 0)
    want = {r.seq: r.x for r in df.select("seq", F.max("v").over(w).alias("x")).collect()}
    got = WD.sliding_max(df, ["k", "g"], "ts", "v", span, "peak")
    assert got.columns == [*df.columns, "peak"]
    assert {r.seq: r.peak for r in got.collect()} == want


def test_trailing_windows(spark):
    clock = spark.createDataFrame([("a", 1_000_000), ("a", 10), ("b", 2_000_000)], "k string, ts long")
    rows = spark.createDataFrame([("a", 700_000, 1), ("a", 699_999, 2), ("a", 100_000, 3), ("a", 99_999, 4), ("a", 1_500_000, 5), ("b", 1_400_000, 6), ("c", 5, 7)], "k string, end_ms long, n int")
    got = {(r.n, r.span) for r in WD.trailing(rows, clock, ["k"], "end_ms").collect()}
    assert got == {(1, "5m"), (1, "10m"), (1, "15m"), (2, "10m"), (2, "15m"), (3, "15m"), (5, "5m"), (5, "10m"), (5, "15m"), (6, "10m"), (6, "15m")}
