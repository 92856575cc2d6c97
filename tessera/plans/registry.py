"""Registry of named queries (Spark) and their DuckDB oracle SQL.

Each registered query takes ``(spark, sf_dir)`` and returns a lazy
DataFrame. Double columns are normalised the same way on both sides
(``round(x * 1e6 + 0.001) / 1e6``: bit-identical in Spark and DuckDB for
identical inputs; the small bias moves exact half-way values, common in
averages of two-decimal data, off the rounding edge so a one-ulp
difference from summation order cannot flip them).
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

_DOUBLES_FILE = os.path.join(os.path.dirname(__file__), "double_columns.json")
SCALE = 1_000_000.0
BIAS = 0.001


def query(name: str, sql: str | None = None):
    """Register ``fn`` as query ``name``; ``sql`` is its DuckDB oracle (None: rows-only check)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def normalise(df: DataFrame) -> DataFrame:
    """Round every double/float column to 1e-6 (same formula as the oracle wrapper)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`").cast("double")
            cols.append(((F.round(c * F.lit(SCALE) + F.lit(BIAS), 0) / F.lit(SCALE)) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(QUERIES[name](spark, sf_dir))


def double_columns() -> dict[str, list[str]]:
    try:
        with open(_DOUBLES_FILE) as fh:
            return json.load(fh)
    except FileNotFoundError:
        return {}


def oracle_sql(name: str) -> str:
    sql = ORACLE[name].strip().rstrip(";")
    dbl = double_columns().get(name, [])
    if not dbl:
        return sql
    rep = ", ".join(
        f'(round(CAST("{c}" AS DOUBLE) * {SCALE} + {BIAS}) / {SCALE}) + 0.0 AS "{c}"' for c in dbl
    )
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _q"


def load_all() -> None:
    """Import every module that registers queries."""
    from . import catalog  # noqa: F401
