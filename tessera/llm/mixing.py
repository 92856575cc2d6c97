"""Mixing sources to target weights with fixed-length blocks (DataFrame operations only).

The words of a source form one stream in document order, cut into blocks of ``block`` words. Each output
shard has ``shard`` slots and draws its sources multinomially, with the sources' shares of all slots. A
source's slots are counted through all shards; what it drew above its quota goes to sources below theirs,
so that the draws add up to the quotas. The k-th slot of a source takes, in pass ``k div blocks`` over the
source, the block that the source's pseudorandom permutation of its block numbers gives for ``k mod blocks``,
and blocks are joined by that number. A source's last, shorter block stands at the end of each pass, and the
source's last slot is cut so that the words taken add up to the rounded target.

The permutation is the swap-or-not shuffle (Hoang, Morris, Rogaway, 2012): any domain size, no table, no
sorting, each round an involution.

Targets: sources in code-point order (null last) weigh ``weights``, repeating, and share ``share`` of all
sizes; a target stops at ``most`` times its source's size and the excess is shared anew by weight.

Defined results: null and empty texts have size 0 and nothing is taken from them; a null source is a source of
its own; repeated rows are documents of their own; ties in the id are ordered by size and then text hash. An empty table gives
an empty result. All draws come from ``seed``, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, packed, running, written

WEIGHTS = (3, 1, 2)
#: Words in a block, slots in an output shard, rounds of the permutation.
BLOCK, SHARD, ROUNDS = 256, 16384, 40


@dataclass
class Mix:
    """``docs``: uid, id, source, size, start (of its words in the source's stream), row if it was asked for.
    ``sources``: source, source_size, rank, weight, target, blocks, quota (slots) and words.
    ``slots``: shard, slot, source_rank, k, pass, block, words (taken from the block's start)."""

    docs: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int


def _ranked(sizes: DataFrame) -> DataFrame:
    """Sources numbered from 0 in code-point order, null last: sorted ranges, numbered apart, then shifted."""
    parts = written(sizes.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1)), "sources")
    return running(parts, [], "part", [F.asc_nulls_last("source")], "one", "rank").drop("part", "one")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds rank, weight and target to (source, source_size)."""
    at = F.col("rank") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int"))
    ranked = written(_ranked(sizes).withColumn("weight", weight.cast("double")), "ranked")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, cap = 0.0, F.lit(most) * F.col("source_size")
    while True:  # each round fixes the sources that are at their cap; it ends when there is no further one
        full = F.col("weight") * F.lit(level) >= cap
        rest, open_weight, open_n = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(~full, 1))).first()
        higher = (total - (rest or 0.0)) / open_weight if open_n else level
        if not open_n or higher <= level:
            break
        level = higher
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def permuted(at: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The place of ``at`` in a pseudorandom permutation of 0 .. n - 1, given by ``key``."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(key, r, F.lit("offset")), n) - x
        other = F.when(other < 0, other + n).otherwise(other)
        return F.when(F.xxhash64(key, r, F.greatest(x, other)) >= 0, x).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), at.cast("long"), swap)


def _pick(points: DataFrame, at: str, ranges: DataFrame, wide: int) -> DataFrame:
    """Joins each point to the range [lo, hi) it lies in, by equal parts of the line."""
    cut = ranges.where("hi > lo").withColumn("_part", F.explode(F.sequence(F.expr(f"lo div {wide}"), F.expr(f"(hi - 1) div {wide}"))))
    p = points.withColumn("_part", F.expr(f"{at} div {wide}"))
    return p.join(cut, "_part").where(f"{at} >= lo and {at} < hi").drop("_part")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: int = 7, whole: bool = False) -> Mix:
    """Plan of the mix; see the module text. ``whole`` keeps the input rows as ``docs.row``."""
    spark = docs.sparkSession
    named = {"id": docs[id_col], "source": docs[source_col], "size": n_words(docs[text_col]), "tie": F.xxhash64(docs[text_col])}
    rows = packed(docs, **named) if whole else docs.select(*[c.alias(n) for n, c in named.items()])
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "mix-docs")
    slim = rows.drop("row")
    # About 5,000 documents to a chunk, whatever the number of documents.
    chunks = slim.count() // 5000 + 1
    slim = slim.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(chunks)))
    placed = running(slim, ["source"], "chunk", [F.asc_nulls_last("id"), F.col("size"), F.col("tie"), F.col("uid")], "size", "start").drop("chunk", "tie")
    placed = written(placed, "mix-placed")

    sources = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    words = F.least(F.round("target"), F.floor(F.lit(most) * F.col("source_size"))).cast("long")
    sources = sources.withColumn("words", words).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    passes = F.expr("case when source_size > 0 then words div source_size else 0 end")
    quota = passes * F.col("blocks") + F.ceil((F.col("words") - passes * F.col("source_size")) / block)
    sources = written(sources.withColumn("quota", quota.cast("long")), "mix-sources")

    # Every slot draws a number below the number of slots, and with it a source; a shard's draws are multinomial.
    total = sources.agg(F.sum("quota")).first()[0] or 0
    w = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sources.select("rank", "quota", F.coalesce(F.sum("quota").over(w), F.lit(0)).alias("lo"))
    ranges = ranges.withColumn("hi", F.col("lo") + F.col("quota"))
    slots = spark.range(total).select(F.expr(f"id div {shard}").alias("shard"), F.col("id").alias("slot"))
    slots = slots.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "slot"), F.lit(max(1, total))))
    drawn = written(_pick(slots, "draw", ranges.select("rank", "quota", "lo", "hi"), shard).select("shard", "slot", "rank", "quota").withColumn("one", F.lit(1)), "mix-draws")
    counted = running(drawn, ["rank"], "shard", [F.col("slot")], "one", "k").select("shard", "slot", "rank", "quota", "k")
    # Slots above a quota fill the sources below theirs, in order.
    have = drawn.groupBy("rank").agg(F.count("*").alias("have"))
    short = sources.select("rank", "quota").join(have, "rank", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    short = short.where("quota > have").withColumn("lo", F.coalesce(F.sum(F.expr("quota - have")).over(w), F.lit(0)))
    short = short.select(F.col("rank").alias("to"), "have", "lo", (F.col("lo") + F.col("quota") - F.col("have")).alias("hi"))
    over = counted.where("k >= quota").select("shard", "slot", F.lit(1).alias("one"))
    moved = _pick(running(over, [], "shard", [F.col("slot")], "one", "x"), "x", short, 1024)
    settled = counted.where("k < quota").select("shard", "slot", "rank", "k").unionByName(
        moved.select("shard", "slot", F.col("to").alias("rank"), (F.col("have") + F.col("x") - F.col("lo")).alias("k")))

    s = settled.join(sources.select("rank", "source_size", "blocks", "quota", "words"), "rank")
    s = s.withColumn("pass", F.expr("k div blocks")).withColumn("at", F.expr("k % blocks"))
    last = F.col("blocks") - 1
    s = s.withColumn("block", F.when(F.col("at") == last, last).otherwise(
        permuted(F.col("at"), F.greatest(last, F.lit(1)), F.xxhash64(F.lit(seed), "rank", "pass"))))
    size = F.when(F.col("block") == last, F.col("source_size") - last * block).otherwise(F.lit(block))
    cut = F.col("words") - F.col("pass") * F.col("source_size") - F.col("at") * block  # words still due at the last slot
    s = s.withColumn("take", F.when(F.col("k") == F.col("quota") - 1, F.least(size, cut)).otherwise(size).cast("long"))
    slots = s.select("shard", "slot", F.col("rank").alias("source_rank"), "k", "pass", "block", F.col("take").alias("words"))
    whole_docs = placed.join(rows.select("uid", "row"), "uid") if whole else placed
    return Mix(whole_docs, sources, slots, block)


def pieces(m: Mix) -> DataFrame:
    """(shard, slot, pass, uid, lo, hi): the words [lo, hi) of each document that each slot takes."""
    docs = m.docs.drop("row").where("size > 0").join(m.sources.select(F.col("source").alias("_source"), "rank"), F.col("source").eqNullSafe(F.col("_source")))
    b = m.block
    parts = docs.select("uid", "size", "start", F.col("rank").alias("source_rank"), F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))).alias("block"))
    both = parts.join(m.slots, ["source_rank", "block"])
    lo, hi = F.greatest(F.lit(0), F.col("block") * b - F.col("start")), F.least(F.col("size"), F.col("block") * b + F.col("words") - F.col("start"))
    return both.select("shard", "slot", "pass", "uid", lo.alias("lo"), hi.alias("hi")).where("hi > lo")


def taken(m: Mix) -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    got = pieces(m).groupBy("uid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    docs = m.docs.drop("row").join(got, "uid", "left")
    s = m.sources.select(F.col("source").alias("_source"), "source_size", "target")
    return docs.join(s, F.col("source").eqNullSafe(F.col("_source"))).select(
        "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(m: Mix, columns: list[str], text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The mix as documents: for each pass that takes words of a document, a row with the words it takes.

    A document taken whole keeps its text as it is; else the taken runs of words are joined by a space.
    Documents without words have nothing to take and are not in the mix.
    """
    got = pieces(m).groupBy("uid", "pass").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"), F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    docs = m.docs.select("uid", "size", "row").join(got, "uid")
    words = F.regexp_extract_all(F.col("row").getField(text_col), F.lit(WORD), F.lit(0))
    # The one-element array binds the words to a variable, so a text is split once and not once a run.
    cut = F.transform(F.array(words), lambda w: F.flatten(F.transform("runs", lambda r: F.slice(w, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))))
    text = F.when(F.col("n") == F.col("size"), F.col("row").getField(text_col)).otherwise(F.concat_ws(" ", cut[0]))
    docs = docs.withColumn("text_out", text)
    new = {text_col: F.col("text_out")} | ({chars_col: F.length("text_out").cast("long")} if chars_col in columns else {})
    return docs.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in columns])
