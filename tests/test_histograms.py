"""Histogram percentile / fraction cases (hand-computed constants)."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import histograms as HG

INF = float("inf")

PCT = [
    ([], 0.5, None),
    ([(0.1, 0.0), (1.0, 0.0)], 0.5, None),
    ([(0.1, 50.0), (1.0, 100.0)], 1.5, None),
    ([(0.1, 50.0), (1.0, 100.0)], 0.5, 0.1),
    ([(0.1, 25.0), (1.0, 100.0)], 0.5, 0.4),
    ([(1.0, 99.0), (INF, 100.0)], 0.995, 1.0),
    ([(INF, 10.0)], 0.5, None),
    ([(0.5, 100.0)], 0.5, 0.25),
    ([(0.5, 900.0), (1.0, 990.0), (INF, 1000.0)], 0.95, 0.5 + (950 - 900) / 90 * 0.5),
]

FRAC = [
    ([(0.1, 50.0), (1.0, 100.0)], 0.1, 0.5),
    ([(0.1, 25.0), (1.0, 100.0)], 0.4, 0.5),
    ([(0.1, 100.0), (1.0, 100.0)], 0.05, 0.5),
    ([(1.0, 99.0), (INF, 100.0)], 5.0, 0.99),
    ([(0.1, 10.0), (1.0, 100.0)], 5.0, 1.0),
    ([(0.0, 0.0), (1.0, 100.0)], -1.0, 0.0),
    ([], 1.0, None),
    ([(0.1, 0.0), (1.0, 0.0)], 1.0, None),
]


def _df(spark, rows, arg):
    data = [(i, [{"le": le, "cum": c} for le, c in b], float(a)) for i, (b, a, _) in enumerate(rows)]
    return spark.createDataFrame(data, "id int, b array<struct<le:double,cum:double>>, a double")


def _check(got, want):
    if want is None:
        assert got is None
    else:
        assert got is not None and math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)


def test_percentile_cases(spark):
    df = _df(spark, PCT, "q").select("id", F.expr(HG.percentile_sql("b", "a")).alias("v"))
    got = {r.id: r.v for r in df.collect()}
    for i, (_, _, want) in enumerate(PCT):
        _check(got[i], want)


def test_fraction_cases(spark):
    df = _df(spark, FRAC, "t").select("id", F.expr(HG.fraction_le_sql("b", "a")).alias("v"))
    got = {r.id: r.v for r in df.collect()}
    for i, (_, _, want) in enumerate(FRAC):
        _check(got[i], want)


def test_goodput_combined_skips_null_and_nan(spark):
    df = spark.createDataFrame([(90.0, None, 95.0), (float("nan"), 80.0, None), (None, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(HG.goodput_combined(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [90.0, 80.0, None]
