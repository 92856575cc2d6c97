"""Chat formatting: multi-party perspective rotation.

Every participant of a conversation gets a rendering of it with that speaker as the assistant, all others as
named users and system turns as they are, and the spans of characters that a loss covers: the assistant's
words with their end mark.

:func:`whole` gives one rendering for each participant, with spans counted from the dialogue's beginning, at
any number of turns. Only a rendering of more than ``WHOLE`` characters is kept in several rows, since a row
must fit into memory: their texts follow one another, and their spans too count from the dialogue's beginning.

:func:`rotated` is the storage form that the renderings are put together from: parts of at most ``turns``
turns, with spans counted from the beginning of their part. Turns are numbered from sorted ranges of the whole
table, and the parts' offsets are running sums of their lengths, not made in one task for a conversation.

Defined results: turns are ordered by turn, role and text, nulls last; repeated rows are turns of their own;
a null role is the speaker ``unknown``, a null text is empty, and turns with null conversation id form one
conversation. A conversation of system turns alone has no participant and no rendering. An empty table
gives an empty result. ``<|`` in a text becomes ``< |``, so that texts can't hold marks. Extra columns are not read. Texts of any
length are rendered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, written

SYSTEM, UNKNOWN = "system", "unknown"
#: Most turns in a part; copies of the participants in the salted join.
TURNS, SALTS = 64, 8
END = "<|end|>\n"
#: Characters of a rendering before another row begins; parts whose lengths are summed in one window.
WHOLE, NEAR = 1 << 26, 64


def _head(speaker: Column, me: Column) -> Column:
    other = F.concat(F.lit("<|user name="), speaker, F.lit("|>\n"))
    return F.when(speaker == SYSTEM, "<|system|>\n").when(speaker == me, "<|assistant|>\n").otherwise(other)


def rotated(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns: int = TURNS) -> DataFrame:
    """One row for each conversation, participant and part: conv_id, perspective, part, n_turns, rendered and
    spans (array of start and end, the end not included)."""
    named = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for n, c in named.items()]).withColumn("uid", F.monotonically_increasing_id())
    order = [F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text"), F.col("uid")]
    rows = rows.repartitionByRange(F.col("conv"), *order).withColumn("chunk", F.spark_partition_id())
    speaker = F.coalesce("role", F.lit(UNKNOWN))
    rows = written(rows.withColumns({"speaker": speaker, "one": F.lit(1)}), "turns")
    placed = running(rows, ["conv"], "chunk", order, "one", "at").withColumn("part", F.expr(f"at div {turns}"))
    clean = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    parts = placed.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("at", "speaker", clean.alias("text")))).alias("turns"))
    parts = parts.withColumn("salt", F.pmod("part", F.lit(SALTS)).cast("int"))
    # Participants go to a few salts, so that the parts of one long conversation are spread over as many tasks.
    own = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("_conv"), F.col("speaker").alias("me")).distinct()
    own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = parts.join(own, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("salt") == F.col("_salt")))

    me = F.col("me")
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(_head(t["speaker"], me), t["text"], F.lit(END))), "")

    def add(so_far: Column, t: Column) -> Column:
        start = so_far["at"] + F.length(_head(t["speaker"], me)).cast("long")
        end = start + F.length(t["text"]).cast("long") + len(END) - 1
        spans = F.when(t["speaker"] == me, F.concat(so_far["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(so_far["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    spans = F.aggregate("turns", empty, add, lambda x: x["spans"])
    return both.select(F.col("conv").alias(conv_col), me.alias("perspective"), "part", F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"), spans.alias("spans"))


def whole(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns: int = TURNS, limit: int = WHOLE) -> DataFrame:
    """One row for each conversation and participant: conv_id, perspective, part, n_turns, rendered and spans, all
    of the whole dialogue. ``part`` is 0; it counts on where a rendering has more than ``limit`` characters."""
    stored = rotated(df, conv_col, turn_col, role_col, text_col, turns)
    stored = stored.select(F.col(f"`{conv_col}`").alias("conv"), F.col("perspective").alias("me"), F.col("part").alias("at"), "n_turns", "rendered", "spans", F.length("rendered").cast("long").alias("size"))
    stored = written(stored, "renderings")
    sizes = stored.select("conv", "me", "at", "size").withColumn("chunk", F.expr(f"at div {NEAR}"))
    before = running(sizes, ["conv", "me"], "chunk", [F.col("at")], "size", "before").select(F.col("conv").alias("_conv"), F.col("me").alias("_me"), F.col("at").alias("_at"), "before")
    placed = stored.join(before, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("me") == F.col("_me")) & (F.col("at") == F.col("_at")))
    moved = F.transform("spans", lambda x: F.struct((x["start"] + F.col("before")).alias("start"), (x["end"] + F.col("before")).alias("end")))
    rows = placed.withColumn("part", F.expr(f"before div {limit}")).groupBy("conv", "me", "part").agg(
        F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("at", "rendered", moved.alias("spans")))).alias("parts"))
    rendered, spans = F.array_join(F.transform("parts", lambda x: x["rendered"]), ""), F.flatten(F.transform("parts", lambda x: x["spans"]))
    return rows.select(F.col("conv").alias(conv_col), F.col("me").alias("perspective"), "part", "n_turns", rendered.alias("rendered"), spans.alias("spans"))
