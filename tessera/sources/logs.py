"""Container logs: frames into lines, in batch and as a keyed stream.

Almost every line lies within one frame and is emitted where it is; only a frame's first and last piece meet others.
Their place in the stream comes from running counts over frames (carried on two levels, see ``operators.windows``).
``log_lines`` puts every line together whole, whatever its length, as what judges a line must see all of it. A viewer
gets a line in parts of at most ``PART`` characters, so that a stream without newlines is cut and never gathered in one
group. Frames are placed once and stored with their places; what follows reads them from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import running_total
from ..session import scratch_dir

#: Characters of a part of a line in a viewer's events; lines up to here have one part.
PART = 1 << 20

# Texts that stand for the stream's end and for an error of it, and the mark of the second stream's lines.
ENDED = "LOG:Stream ended - container stopped"
FAILED = "ERR:Log stream error: "
STDERR = "[stderr] "


def _cut(text: Column, start: Column, part: int) -> Column:
    """(part, from, text) of a text that begins ``start`` characters into its line."""
    n = F.length(text)
    first = F.floor(start / part).cast("bigint")
    last = F.floor((start + F.greatest(n, F.lit(1)) - 1) / part).cast("bigint")

    def one(k: Column) -> Column:
        a, b = F.greatest(start, k * part), F.least(start + n, (k + 1) * part)
        return F.struct(k.alias("part"), a.alias("from"), F.substr(text, (a - start + 1).cast("int"), (b - a).cast("int")).alias("text"))

    most = F.when(first == last, F.array(F.struct(first.alias("part"), start.alias("from"), text.alias("text")))).otherwise(F.transform(F.sequence(first, last), one))
    return F.when((n > 0) | (start == 0), most)


def _stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: its windows and joins aren't repeated for each use."""
    path = scratch_dir(df.sparkSession, "log-frames")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _placed(frames: DataFrame, keys: list[str], seq: str, text: str, seq_chunk: int) -> DataFrame:
    """(keys, _seq, _text, _nl, _chars, _before, _from): each frame's newlines and characters, and those of its stream before it."""
    f = frames.select(*keys, seq, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    f = f.withColumn("_chars", F.length("_text").cast("bigint")).withColumn("_nl", F.col("_chars") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))))
    f = f.withColumn("_k", F.concat_ws("\u0001", *[F.col(k) for k in keys])).withColumn("_tie", F.xxhash64("_text"))
    f = running_total(f, "_k", seq, "_tie", ["_nl", "_chars"], chunk_ms=seq_chunk)
    return f.select(*keys, F.col(seq).alias("_seq"), "_text", "_nl", "_chars",
                    (F.col("_nl_run") - F.col("_nl")).alias("_before"), (F.col("_chars_run") - F.col("_chars")).alias("_from"))


def _pieces(f: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The texts between newlines, (keys, _seq, _nl, line_no, _i, _piece): whole lines, and frames' first and last pieces with ``_at``, their place."""
    p = f.select(*keys, "_seq", "_nl", "_before", "_from", "_chars", F.posexplode(F.split("_text", "\n", -1)).alias("_i", "_piece"))
    p = p.withColumn("line_no", F.col("_before") + F.col("_i"))
    inner = (F.col("_i") > 0) & (F.col("_i") < F.col("_nl"))
    # A frame's first piece begins where the frame does, its last one so many characters before the frame's end.
    at = F.col("_from") + F.when(F.col("_i") == 0, 0).otherwise(F.col("_chars") - F.length("_piece"))
    return p.where(inner), p.where(~inner).withColumn("_at", at)


def assembled(frames: DataFrame, keys: list[str], seq: str, text: str, seq_chunk: int = 1 << 20, part: int = PART) -> DataFrame:
    """(keys, line_no, part, text, done, full, at_seq, at_pos): every line; ``done`` if a newline ends it, ``full`` if a part follows.

    ``at_seq``, ``at_pos``: the frame that holds the line's end, and the number of newlines before it there.
    """
    f = _placed(frames, keys, seq, text, seq_chunk)
    f = f.withColumn("_first", F.length(F.substring_index("_text", "\n", 1)).cast("bigint")).withColumn("_last", F.length(F.substring_index("_text", "\n", -1)).cast("bigint"))
    f = _stored(f)
    whole, edge = _pieces(f, keys)
    whole = whole.select(*keys, "line_no", F.inline(_cut(F.col("_piece"), F.lit(0).cast("bigint"), part)), F.col("_seq").alias("at_seq"), F.col("_i").cast("bigint").alias("at_pos"))
    whole = whole.select(*keys, "line_no", "part", "text", F.lit(True).alias("done"), F.lit(True).alias("full"), "at_seq", "at_pos")
    # The lines' extents come from the stored numbers, without the texts.
    head = F.struct(F.col("_before").alias("_line"), F.col("_from").alias("_at"), F.col("_first").alias("_n"), (F.col("_nl") > 0).alias("_done"))
    tail = F.struct((F.col("_before") + F.col("_nl")).alias("_line"), (F.col("_from") + F.col("_chars") - F.col("_last")).alias("_at"), F.col("_last").alias("_n"), F.lit(False).alias("_done"))
    ends = f.select(*[F.col(k).alias(f"_{k}") for k in keys], "_seq", F.explode(F.when(F.col("_nl") > 0, F.array(head, tail)).otherwise(F.array(head))).alias("_e"))
    line = ends.select(*[f"_{k}" for k in keys], "_seq", "_e.*").groupBy(*[f"_{k}" for k in keys], "_line").agg(
        F.min("_at").alias("_begin"), F.max(F.col("_at") + F.col("_n")).alias("_end"), F.max("_done").alias("done"), F.max("_seq").alias("at_seq"))
    same = F.col("line_no") == F.col("_line")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    cut = edge.join(line, same).select(*keys, "line_no", "done", "at_seq", (F.col("_end") - F.col("_begin")).alias("_chars"), F.inline(_cut(F.col("_piece"), F.col("_at") - F.col("_begin"), part)))
    joined = cut.groupBy(*keys, "line_no", "part", "done", "at_seq", "_chars").agg(F.array_sort(F.collect_list(F.struct("from", "text"))).alias("_p"))  # at most PART characters
    joined = joined.select(*keys, "line_no", "part", F.array_join(F.transform("_p", lambda x: x["text"]), "").alias("text"), "done",
                           (F.col("_chars") > (F.col("part") + 1) * part).alias("full"), "at_seq", F.lit(0).cast("bigint").alias("at_pos"))
    return whole.unionByName(joined)


def _marked(kind: Column, part: Column, text: Column) -> Column:
    return F.when((kind == "stderr") & (part == 0), F.concat(F.lit(STDERR), text)).otherwise(text)


def log_lines(chunks: DataFrame, keys: list[str] = ("container", "stream"), seq: str = "seq", text: str = "chunk", seq_chunk: int = 1 << 20) -> DataFrame:
    """(keys, line_no, line): complete streams, a row for each whole line; what follows the last newline is a line if it isn't empty."""
    keys = list(keys)
    whole, edge = _pieces(_stored(_placed(chunks, keys, seq, text, seq_chunk)), keys)
    # A line is one value, so the group of its pieces is no larger than the row that is asked for.
    joined = edge.groupBy(*keys, "line_no").agg(F.max(F.col("_i") < F.col("_nl")).alias("_done"), F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY _at)").alias("_line"))
    joined = joined.where(F.col("_done") | (F.col("_line") != ""))
    lines = whole.select(*keys, "line_no", F.col("_piece").alias("_line")).unionByName(joined.drop("_done"))
    return lines.select(*keys, "line_no", _marked(F.col("stream"), F.lit(0), F.col("_line")).alias("line"))


def log_events(frames: DataFrame, container: str = "container", kind: str = "kind", seq: str = "seq", text: str = "chunk",
               seq_chunk: int = 1 << 20, part: int = PART) -> DataFrame:
    """(container, kind, seq, pos, part, line): what a viewer of each container's log gets, by the frame that brings it.

    Frames are of kind stdout, stderr, console, error or end; others are not shown. Console frames are lines as they are.
    The first error or end closes the log: an end brings the unfinished lines and a marker, an error only its marker,
    and what follows is not read. A log that is still open, or has failed, keeps the unfinished part of a line back.
    """
    f = frames.select(F.col(container).alias("container"), F.col(kind).alias("kind"), F.col(seq).alias("seq"), F.col(text).alias("chunk"))
    stops = f.where(F.col("kind").isin("error", "end")).groupBy(F.col("container").alias("_container")).agg(F.min(F.struct("seq", "kind", "chunk")).alias("_stop"))
    live = f.join(stops, F.col("container").eqNullSafe(F.col("_container")), "left").where(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop.seq")))
    lines = assembled(live.where(F.col("kind").isin("stdout", "stderr")), ["container", "kind"], "seq", "chunk", seq_chunk, part)
    lines = lines.join(stops.where(F.col("_stop.kind") == "end").select("_container", F.col("_stop.seq").alias("_end")), F.col("container").eqNullSafe(F.col("_container")), "left")
    left = F.col("done") | (F.col("full") & F.col("_end").isNull())
    lines = lines.where(left | (F.col("_end").isNotNull() & (F.col("text") != ""))).select(
        "container", "kind", F.when(left, F.col("at_seq")).otherwise(F.col("_end")).alias("seq"),
        F.when(left, F.col("at_pos")).otherwise((F.col("kind") == "stderr").cast("bigint")).alias("pos"), "part",
        _marked(F.col("kind"), F.col("part"), F.col("text")).alias("line"))
    zero = F.lit(0).cast("bigint")
    console = live.where(F.col("kind") == "console").select("container", "kind", "seq", zero.alias("pos"), zero.alias("part"), F.coalesce("chunk", F.lit("")).alias("line"))
    marker = F.when(F.col("_stop.kind") == "end", F.lit(ENDED)).otherwise(F.concat(F.lit(FAILED), F.coalesce("_stop.chunk", F.lit(""))))
    closed = stops.select(F.col("_container").alias("container"), F.col("_stop.kind").alias("kind"), F.col("_stop.seq").alias("seq"), F.lit(2).cast("bigint").alias("pos"), zero.alias("part"), marker.alias("line"))
    return lines.unionByName(console).unionByName(closed)


EVENTS = "container string, kind string, seq long, pos long, part long, line string"


class _Lines(StatefulProcessor):
    """The unfinished line of both streams of a container; a timer closes a log that has been silent for ``idle_ms``."""

    def __init__(self, idle_ms: int, part: int):
        self.idle_ms, self.part = idle_ms, part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("log", "stdout string, stdout_part long, stderr string, stderr_part long, seq long, closed boolean")

    def _load(self) -> dict:
        names = ("stdout", "stdout_part", "stderr", "stderr_part", "seq", "closed")
        return dict(zip(names, self.state.get())) if self.state.exists() else dict(zip(names, ("", 0, "", 0, -1, False)))

    def _take(self, s: dict, kind: str, text: str, done: bool, seq: int, pos: int) -> Iterator[tuple]:
        """Adds a piece to the unfinished line; full parts leave, and the rest too if the line is done."""
        own, k = s[kind] + text, s[f"{kind}_part"]
        while len(own) > self.part or done:
            head, own = own[: self.part], own[self.part :]
            yield kind, seq, pos, k, (STDERR if kind == "stderr" and k == 0 else "") + head
            k += 1
            if not own and done:
                k = 0
                break
        s[kind], s[f"{kind}_part"] = own, k

    def _close(self, s: dict, seq: int) -> Iterator[tuple]:
        for pos, kind in enumerate(("stdout", "stderr")):
            if s[kind]:
                yield from self._take(s, kind, "", True, seq, pos)
        yield "end", seq, 2, 0, ENDED
        s["closed"] = True

    def _frame(self, s: dict, kind: str, seq: int, text: str) -> Iterator[tuple]:
        if kind == "end":
            yield from self._close(s, seq)
        elif kind == "error":
            yield "error", seq, 2, 0, FAILED + text
            s.update(stdout="", stderr="", closed=True)
        elif kind == "console":
            yield "console", seq, 0, 0, text
        elif kind in ("stdout", "stderr"):
            *lines, rest = text.split("\n")
            for pos, line in enumerate(lines):
                yield from self._take(s, kind, line, True, seq, pos)
            yield from self._take(s, kind, rest, False, seq, len(lines))

    def _put(self, key, s: dict, out: list[tuple]) -> Iterator[pd.DataFrame]:
        self.state.update((s["stdout"], s["stdout_part"], s["stderr"], s["stderr_part"], s["seq"], s["closed"]))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["container", "kind", "seq", "pos", "part", "line"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        latest = 0
        for frame in rows:
            out: list[tuple] = []
            for kind, seq, text, at in zip(frame["kind"], frame["seq"], frame["chunk"], frame["event_time"]):
                latest = max(latest, int(at.timestamp() * 1000))
                if not s["closed"]:
                    s["seq"] = int(seq)
                    out += self._frame(s, kind, int(seq), text or "")
            yield from self._put(key, s, out)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not s["closed"]:
            self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        if not s["closed"]:
            out = list(self._close(s, s["seq"] + 1))
            yield from self._put(key, s, out)

    def close(self) -> None:
        pass


def log_event_stream(frames: DataFrame, watermark: str = "1 minute", idle_ms: int = 600_000, part: int = PART) -> DataFrame:
    """:func:`log_events` of a stream of frames (container, kind, seq, chunk, event_time), as they come.

    A container's frames must come in the order of ``seq``. A log that is silent for ``idle_ms`` of event time is closed as
    an end frame would close it. The state of a container is at most two parts of a line. Needs the RocksDB state store.
    """
    timed = frames.select("container", "kind", "seq", "chunk", "event_time").withWatermark("event_time", watermark)
    return timed.groupBy("container").transformWithStateInPandas(_Lines(idle_ms, part), EVENTS, outputMode="Append", timeMode="EventTime")
