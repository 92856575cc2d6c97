"""Exact deduplication with a heavy-hitter split.

A Misra-Gries pass over the digests finds the frequent ones. Their groups are counted exactly, and the
verified winners (at most ``counters + 1`` rows) are broadcast, so the rows of large groups are decided
map-side. The remaining digests, whose groups have fewer than ``2 n / (counters + 1)`` of the ``n`` rows,
take an ordinary shuffle.

Defined results: a null text counts as empty; all empty texts form one group. Of equal texts the row with
the most code points stays, then the one with the smallest id (null ids last), then any one of the rows that
are alike in both. Repeated rows are rows of their own: exactly one row of a group is kept. An empty table
gives an empty result. Extra columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, packed, unpacked, written

#: Misra-Gries counters a task keeps; bounds the broadcast to COUNTERS + 1 rows.
COUNTERS = 1023


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", "")


def misra_gries(df: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Lower-bound counts ``(value, estimate)`` of the frequent values of a binary column.

    Every task keeps ``counters`` counters and the tasks' summaries are added up. An estimate is below the
    true count by at most ``n / (counters + 1)``. The sum goes over at most ``counters`` rows of each task.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                kept[x["values"]] = kept.get(x["values"], 0) + x["counts"]
            if len(kept) > counters:
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = {v: n - cut for v, n in kept.items() if n > cut}
        yield pa.RecordBatch.from_pydict({"value": pa.array(kept.keys(), pa.binary()), "estimate": pa.array(kept.values(), pa.int64())})

    tasks = df.select(column).mapInArrow(summarise, "value binary, estimate long")
    return tasks.groupBy("value").agg(F.sum("estimate").alias("estimate"))


def _order() -> Column:
    """Smallest for the row of a group that stays."""
    return F.struct((-F.col("n_cp")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("uid").alias("uid"))


def _digested(df: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """One row per input row with its digest, written once; ``uid`` is fixed by that."""
    named = {"id": df[id_col], "n_cp": F.length(F.coalesce(df[text_col], F.lit(""))).cast("long"),
             "digest": F.unhex(F.sha2(normalised(df[text_col]).cast("binary"), 256))}
    rows = packed(df, **named) if whole else df.select(*[c.alias(n) for n, c in named.items()])
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "digests")


def _winners(rows: DataFrame, counters: int) -> DataFrame:
    """(digest, win, size) of the heavy digests, verified by exact counts; at most ``counters + 1`` rows."""
    n = rows.count()
    heavy = misra_gries(rows, "digest", counters).where((F.col("estimate") >= 2) & (F.col("estimate") * (counters + 1) >= n))
    # The estimates add up to n at most, so at most counters + 1 of them reach n / (counters + 1).
    own = rows.select("id", "n_cp", "digest", "uid").join(F.broadcast(heavy.select(F.col("value").alias("digest"))), "digest", "left_semi")
    return written(own.groupBy("digest").agg(F.min(_order()).alias("win"), F.count("*").alias("size")), "winners")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = _digested(df, id_col, text_col, whole=False)
    marked = rows.join(F.broadcast(_winners(rows, counters)), "digest", "left")
    heavy = marked.where("win is not null").select(
        "id", F.col("win.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("uid") == F.col("win.uid")).alias("kept"), "digest")
    group = Window.partitionBy("digest")
    first = group.orderBy(F.desc("n_cp"), F.asc_nulls_last("id"), "uid")
    tail = marked.where("win is null").select(
        "id", F.first("id").over(first).alias("keep_id"), F.count("*").over(group).alias("group_size"),
        (F.row_number().over(first) == 1).alias("kept"), "digest")
    return heavy.unionByName(tail).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``df`` that stay, all columns as they were."""
    rows = _digested(df, id_col, text_col, whole=True)
    marked = rows.join(F.broadcast(_winners(rows, counters)), "digest", "left")
    heavy = marked.where("uid = win.uid")
    # Losers are found on the slim columns; only then do whole rows move, once.
    slim = marked.where("win is null").select("id", "n_cp", "digest", "uid")
    first = Window.partitionBy("digest").orderBy(F.desc("n_cp"), F.asc_nulls_last("id"), "uid")
    losers = slim.withColumn("at", F.row_number().over(first)).where("at > 1").select("uid")
    tail = marked.where("win is null").join(losers, "uid", "left_anti")
    return unpacked(heavy.select("row").unionByName(tail.select("row")), df.columns)
