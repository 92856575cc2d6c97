"""Warm-up baselines against one pass over the polls in order; literal cases; histograms."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import warmup as WU

COUNTERS = ["a", "b", "n"]


def polls(spark, rows):
    return spark.createDataFrame(rows, "engine_key string, ts long, seq long, a double, b double, n double")


def in_order(rows, skip):
    """Poll by poll: {(engine, ts, seq): (warming, just, epoch, adjusted)}."""
    out, base, low, epoch = {}, {}, {}, {}
    for key, ts, seq, *values in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen, just = int(values[2] or 0), False
        if base.get(key) and any(b is not None and v is not None and v < b for v, b in zip(values, base[key])):
            base[key], low[key] = None, seen
        elif not base.get(key):
            before = low.get(key, seen)
            low[key] = min(before, seen)
            if seen >= before and seen - before >= skip:
                base[key], epoch[key], just = values, ts, True
        b = base.get(key)
        adjusted = [v if not b or v is None or x is None else max(v - x, 0.0) for v, x in zip(values, b or values)]
        out[key, ts, seq] = (not b, just, epoch.get(key), tuple(adjusted))
    return out


def got(df):
    return {(r.engine_key, r.ts, r.seq): (r.warming_up, r.just_transitioned, r.epoch, (r.adj_a, r.adj_b, r.adj_n)) for r in df.collect()}


def random_polls(seed, engines=6, n=60):
    rng = random.Random(seed)
    rows = []
    for e in range(engines):
        a = b = c = float(rng.randint(0, 5))
        for k in range(n):
            if rng.random() < 0.12:  # a restart, or a part of one
                a, b, c = (x if rng.random() < 0.3 else float(rng.randint(0, 4)) for x in (a, b, c))
            a, b, c = a + rng.choice([0, 0, 1, 5]), b + rng.choice([0, 2]), c + rng.choice([0, 0, 0, 1, 2, 7])
            hidden = [None if rng.random() < 0.1 else x for x in (a, b, c)]
            rows.append((f"e{e}", 1_000_000 * (k // 7) + 3_000_000_00 * (k // 20), k, *hidden))
    return rows


@pytest.mark.parametrize("skip", [0, 1, 3, 10])
def test_equal_to_one_pass_in_order(spark, skip):
    rows = random_polls(skip)
    want = in_order(rows, skip)
    assert got(WU.baselined(polls(spark, rows).repartition(5), COUNTERS, "n", skip)) == want
    assert len({v[2] for v in want.values()}) > 4 and any(v[0] for v in want.values())


def test_few_polls_decide(spark):
    """What is folded in order grows with the restarts, not with the polls."""
    rows = [("e", k, k, float(k % 500), float(k % 500), float((k % 500) // 3)) for k in range(4000)]
    deciding = WU.deciding_polls(polls(spark, rows), COUNTERS, "n", 1, "engine_key", "ts", "seq")
    assert 8 <= deciding.count() <= 4 * 8
    assert got(WU.baselined(polls(spark, rows), COUNTERS, "n", 1)) == in_order(rows, 1)


def test_transition_and_restart(spark):
    rows = [("e", 1, 1, 100.0, 10.0, 5.0), ("e", 2, 2, 150.0, 10.0, 6.0), ("e", 3, 3, 400.0, 30.0, 9.0), ("e", 4, 4, 10.0, 1.0, 1.0)]
    out = got(WU.baselined(polls(spark, rows), COUNTERS, "n"))
    assert out["e", 1, 1] == (True, False, None, (100.0, 10.0, 5.0))
    assert out["e", 2, 2] == (False, True, 2, (0.0, 0.0, 0.0))
    assert out["e", 3, 3] == (False, False, 2, (250.0, 20.0, 3.0))
    assert out["e", 4, 4] == (True, False, 2, (10.0, 1.0, 1.0))


def test_missing_counters(spark):
    rows = [("e", 1, 1, None, 5.0, 2.0), ("e", 2, 2, 60.0, None, None), ("e", 3, 3, 70.0, 7.0, 4.0)]
    out = got(WU.baselined(polls(spark, rows), COUNTERS, "n", 0))
    assert out["e", 1, 1] == (False, True, 1, (None, 0.0, 0.0))  # nothing to skip: the first poll is the baseline
    assert out["e", 2, 2] == (False, False, 1, (60.0, None, None))  # a counter that the baseline lacks passes
    assert out["e", 3, 3] == (False, False, 1, (70.0, 2.0, 2.0))


def test_empty(spark):
    assert WU.baselined(polls(spark, []), COUNTERS, "n").collect() == []


@pytest.mark.parametrize("cut", [1, 17, 40])
def test_states_carry_on(spark, cut):
    """Polls in two goes, the second from the states of the first, equal one go."""
    rows = random_polls(9)
    first, second = ([r for r in rows if (r[2] < cut) == early] for early in (True, False))
    start = WU.folded(polls(spark, first), COUNTERS, "n").drop("changes")
    out = got(WU.baselined(polls(spark, second), COUNTERS, "n", start=start))
    want = {k: v for k, v in in_order(rows, 1).items() if k[2] >= cut}
    strip = lambda d: {k: (v[0], v[1], v[3]) for k, v in d.items()}
    assert strip(out) == strip(want)


def test_histograms_since_their_baseline(spark):
    states = spark.createDataFrame([("e", 1, True, False, None), ("e", 2, False, True, 2), ("e", 3, False, False, 2), ("e", 4, True, False, 2), ("e", 5, False, True, 5), ("e", 6, False, False, 5)],
                                   "engine_key string, tick long, warming_up boolean, just_transitioned boolean, epoch long")
    h = lambda *c: list(zip((0.1, 1.0, float("inf")), map(float, c)))
    rows = [("e", t, "h", None, x) for t, x in [(1, h(1, 1, 1)), (2, h(2, 3, 4)), (3, h(5, 3, 9)), (4, h(1, 1, 1)), (6, h(4, 4, 4))]]  # not in the baseline of 5
    rows += [("e", 2, "other", None, h(1, 2, 3)), ("e", 3, "other", None, h(4, 5, 6)[:2]), ("e", 3, "late", None, h(1, 1, 1)), ("e", 2, "c", 10.0, None), ("e", 3, "c", 4.0, None), ("e", 6, "c", 7.0, None)]
    df = spark.createDataFrame(rows, "engine_key string, tick long, metric string, value double, hist array<struct<le: double, cum: double>>")
    out = {(r.tick, r.metric): (r.value, r.hist and [x.cum for x in r.hist]) for r in WU.subtract_baseline(df, states, "engine_key", "tick").collect()}
    assert out == {(1, "h"): (None, [1, 1, 1]), (2, "h"): (None, [0, 0, 0]), (3, "h"): (None, [3, 0, 5]), (4, "h"): (None, [1, 1, 1]), (6, "h"): (None, [4, 4, 4]),
                   (2, "other"): (None, [0, 0, 0]), (3, "late"): (None, [1, 1, 1]), (2, "c"): (0.0, None), (3, "c"): (0.0, None), (6, "c"): (7.0, None)}
