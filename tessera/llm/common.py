"""Helpers shared by the training-data operators.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``, so that every executor
and the driver see them and a lost executor costs no recomputation beyond its running tasks.
"""

from __future__ import annotations

import atexit
import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

#: White space of the contracts: space and U+0009 to U+000D, as a regular-expression class body.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"

_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder (removed when the driver ends)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts reach Python tasks by the thousand: a batch of long ones still fits."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: a cut of the lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(path: str, spark: SparkSession) -> None:
    """Remove a folder made by :func:`scratch`."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_stage: list[tuple[SparkSession, str]] = []


def stage(f):
    """A pipeline stage. Before it runs, the intermediate tables of the stage before go: whoever calls stages
    writes each one's result before calling the next."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for s, path in _stage:
            release(path, s)
        _made[:] = [x for x in _made if x not in _stage]
        small_batches(spark)
        start = len(_made)
        out = f(spark, docs, sf_dir)
        _stage[:] = _made[start:]
        return out

    return run


@atexit.register
def _release_all() -> None:
    for spark, path in _made:
        try:
            release(path, spark)
        except Exception:  # the session has ended already; the cluster's own cleaning applies
            return


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """``named`` columns beside the whole row as the struct ``row``: extra columns can't clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(n) for n, c in named.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that :func:`packed` put away."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def n_words(text: Column) -> Column:
    """Number of words (null: 0), as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running(df: DataFrame, keys: list[str], chunk: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` in the rows before, in the order (chunk, order), for each key.

    The chunks are summed first, so one window has a chunk's rows or one row per chunk.
    """
    before = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(chunk).alias("_chunk"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_carry"))
    on = F.col(chunk) == F.col("_chunk")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inner = df.withColumn("_in", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return inner.join(carry, on).withColumn(out, F.col("_in") + F.col("_carry")).drop("_in", "_chunk", "_carry", *[f"_{k}" for k in keys])
