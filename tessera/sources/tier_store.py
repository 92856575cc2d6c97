"""The three tiers as stored tables: Parquet, a folder each, a partition for each day, sorted by engine and time in files.

A read names engines and times as literals, so that days are pruned as partitions and the rest as row groups. Jobs that
change stored rows rewrite the days they touch, and drop a day whole where nothing of it stays. A change of every row goes
to a new folder, whose marker is written last: a folder without it is not finished and is written anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import DAY_MS, idiv
from ..operators import tiers as T

_LONG = {"ts", "bucket_ts", "total_prompt_tokens", "total_gen_tokens", "total_requests", "active_requests", "queued_requests",
         "active_requests_max", "queued_requests_max", "sample_count", "preemptions_total"}


def _typed(columns: list[str]) -> list[tuple[str, str]]:
    return [(c, "string" if c == "engine_key" else "bigint" if c in _LONG else "double") for c in columns]


#: Tier -> (time column, columns with types).
TIERS = {"raw": ("ts", _typed(T.RAW_COLUMNS)), "hour": ("bucket_ts", _typed(T.TIER_COLUMNS)), "day": ("bucket_ts", _typed(T.TIER_COLUMNS))}
#: Tier -> its power column.
POWER = {"raw": "power_watts", "hour": "power_watts_sum", "day": "power_watts_sum"}
#: Columns that later versions added to a tier; rows written before have none of them.
ADDED = {"raw": ["preemptions_total", "queue_time_ms", "tpot_ms"],
         "hour": ["kv_cache_pct_max", "preemptions_total", "queue_time_ms_avg", "tpot_ms_avg"],
         "day": ["kv_cache_pct_max", "preemptions_total", "queue_time_ms_avg", "tpot_ms_avg"]}


@dataclass(frozen=True)
class Request:
    """Rows of one engine (None: every engine) in a time range, both ends included."""

    id: int
    since_ms: int
    until_ms: int
    engine_key: str | None = None


def write(df: DataFrame, folder: str, tier: str, mode: str = "append") -> None:
    """``mode`` "overwrite" replaces the days that ``df`` has rows of (dynamic partition overwrite).

    Columns that ``df`` lacks are left out of the files. A hot engine's day is spread over tasks by the range of time.
    """
    at, schema = TIERS[tier]
    rows = df.select(*[F.col(c).cast(t).alias(c) for c, t in schema if c in df.columns], idiv(F.col(at), DAY_MS).cast("int").alias("day"))
    order = ["day", "engine_key", at]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(f"{folder}/{tier}"))


def read(spark: SparkSession, folder: str, tier: str) -> DataFrame:
    """The tier's rows and ``day``. Columns that older files lack come as nulls."""
    return spark.read.schema(", ".join(f"{c} {t}" for c, t in TIERS[tier][1]) + ", day int").parquet(f"{folder}/{tier}")


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same times as few ranges that don't overlap (both ends included)."""
    out: list[tuple[int, int]] = []
    for since, until in sorted(s for s in spans if s[0] <= s[1]):
        if out and since <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], until)
        else:
            out.append((since, until))
    return out


def any_of(column: Column, spans: Iterable[tuple[int, int]]) -> Column:
    """``column`` is in one of the ranges; literals, so that a scan can use them."""
    out = F.lit(False)
    for k, (since, until) in enumerate(merged(spans)):
        one = (column >= F.lit(since)) & (column <= F.lit(until))
        out = out | one if k else one
    return out


def bounded(df: DataFrame, at: str, spans: list[tuple[int, int]]) -> DataFrame:
    """Rows of the ranges. If ``df`` is a stored tier, days outside them are not read."""
    df = df.where(any_of(F.col(at), spans))
    return df.where(any_of(F.col("day"), [(a // DAY_MS, b // DAY_MS) for a, b in spans])) if "day" in df.columns else df


def scan(spark: SparkSession, folder: str, tier: str, requests: list[Request]) -> DataFrame:
    """(request_id, the tier's columns): the rows that each request asks for. The requests are parameters, not data."""
    at, schema = TIERS[tier]
    rows = bounded(read(spark, folder, tier), at, [(r.since_ms, r.until_ms) for r in requests])
    named = {r.engine_key for r in requests}
    if None not in named:
        rows = rows.where(F.col("engine_key").isin(sorted(named)))
    asked = F.array(*[F.struct(F.lit(r.id).alias("request_id"), F.lit(r.engine_key).cast("string").alias("engine"), F.lit(r.since_ms).cast("bigint").alias("since"),
                               F.lit(r.until_ms).cast("bigint").alias("until")) for r in requests])
    fits = F.filter(asked, lambda r: F.coalesce(r["engine"] == F.col("engine_key"), r["engine"].isNull()) & F.col(at).between(r["since"], r["until"]))
    return rows.select(F.explode(F.transform(fits, lambda r: r["request_id"])).alias("request_id"), *[c for c, _ in schema])


# ------------------------------------------------------------------ jobs


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def days(spark: SparkSession, folder: str, tier: str) -> list[int]:
    """The days that the tier has a partition of, from the folder's listing."""
    fs, p = _folder(spark, f"{folder}/{tier}")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix("day=")) for n in names if n.startswith("day="))


def rewrite(spark: SparkSession, folder: str, tier: str, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
    """``change`` replaces the rows of the touched days.

    What stays is written to the shared checkpoint folder first, so the overwrite never reads files that it replaces.
    Running it again gives the same rows, if ``change`` applied twice does.
    """
    if not touched:
        return
    rows = change(bounded_days(read(spark, folder, tier), touched)).drop("day").checkpoint()
    write(rows, folder, tier, "overwrite")
    left = {r[0] for r in rows.select(idiv(F.col(TIERS[tier][0]), DAY_MS).cast("int")).distinct().collect()}  # days, at most the touched ones
    for d in set(touched) - left:
        _drop(spark, f"{folder}/{tier}/day={d}")


def bounded_days(df: DataFrame, touched: list[int]) -> DataFrame:
    return df.where(any_of(F.col("day"), [(d, d) for d in touched]))


def purge(spark: SparkSession, folder: str) -> None:
    """Drops the rows of every tier whose token count looks cumulative; only days with such rows are rewritten."""
    for tier in TIERS:
        rows = read(spark, folder, tier)
        bad = rows.where(F.col("total_prompt_tokens") > F.lit(T.PURGE_LIMIT)).select("day").distinct()
        rewrite(spark, folder, tier, [r[0] for r in bad.collect()], T.purge_cumulative)


def prune(spark: SparkSession, folder: str, older_than_ms: int) -> dict[str, int]:
    """Drops the rows before ``older_than_ms`` of every tier; tier -> rows dropped.

    Whole days go as folders; the day of the bound is rewritten.
    """
    counts = {}
    edge = older_than_ms // DAY_MS
    for tier, (at, _) in TIERS.items():
        counts[tier] = bounded(read(spark, folder, tier), at, [(-(2**62), older_than_ms - 1)]).count()
        found = days(spark, folder, tier)
        rewrite(spark, folder, tier, [d for d in found if d == edge], lambda df, at=at: T.retention_prune(df, at, older_than_ms))
        for d in found:
            if d < edge:
                _drop(spark, f"{folder}/{tier}/day={d}")
    return counts


def markers(spark: SparkSession, folder: str) -> DataFrame:
    """(key, value): one-time changes that the folder's rows have been through."""
    path = f"{folder}/markers"
    return spark.read.schema("key string, value string").parquet(path) if exists(spark, path) else spark.createDataFrame([], "key string, value string")


def marked(spark: SparkSession, folder: str, key: str) -> bool:
    return not markers(spark, folder).where(F.col("key") == key).isEmpty()


def backfill_power(spark: SparkSession, folder: str, target: str, key: str = "power_backfill_done", factor: float = 4.0) -> str:
    """The folder whose three tiers have their power multiplied by ``factor`` once: ``folder`` if its marker says so, else ``target``.

    ``target`` gets the changed tiers, then the markers. Interrupted before that, it is written anew by the next run.
    """
    if marked(spark, folder, key):
        return folder
    if not marked(spark, target, key):
        _drop(spark, target)
        for tier, column in POWER.items():
            write(read(spark, folder, tier).withColumn(column, F.col(column) * F.lit(factor)), target, tier)
        added = spark.range(1).select(F.lit(key).alias("key"), F.lit(f"{factor:g}").alias("value"))
        markers(spark, folder).unionByName(added).coalesce(1).write.parquet(f"{target}/markers")
    return target
