"""Fill-in-the-middle over seekable compressed frames.

Each text is stored as independent zstandard frames, cut where a unit (``[A-Za-z]+|[^A-Za-z]``) begins, beside the
cumulative counts of units and code points before every frame. A cut in units is found in the counts, and only the
frame that holds it is decompressed. An output is streamed frame by frame into its digest and into a reader that
rebuilds the text from the output alone, so that neither needs more than a frame beside what is compressed.

Defined results: a null text counts as empty; empty texts, and texts that hold one of the marks, are ``plain``. A null
id counts as the empty string where the cuts are drawn. Rows with equal ids and texts get equal results, one each. A run
of letters longer than a frame stays in one frame. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a frame, up to the next unit.
FRAME = 1 << 14

#: Marks before the three parts, and the order of the parts by form. Fixed values.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}


def unit_starts(text: str) -> np.ndarray:
    """Code point at which each unit begins."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((codes | 32) - np.uint32(97)) < 26
    begins = np.ones(len(codes), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def cut_frames(text: str, size: int = FRAME) -> tuple[list[str], list[int], list[int]]:
    """The text's frames; units and code points before each, and in all."""
    starts = unit_starts(text)
    bounds = [0] if text else []
    while bounds and len(text) - bounds[-1] > size:
        k = int(np.searchsorted(starts, bounds[-1] + size))
        if k == len(starts):
            break
        bounds.append(int(starts[k]))
    chars = [*bounds, len(text)]
    units = [int(x) for x in np.searchsorted(starts, chars)]
    return [text[a:b] for a, b in zip(chars, chars[1:])], units, chars


class Framed:
    """A reader of one stored text."""

    def __init__(self, frames: list[bytes], units: list[int], chars: list[int], unpack: zstandard.ZstdDecompressor):
        self.frames, self.units, self.chars, self.unpack = frames, units, chars, unpack
        self.opened = 0
        self._last: tuple[int, str] = (-1, "")

    def text(self, k: int) -> str:
        if self._last[0] != k:
            self.opened += 1
            self._last = k, self.unpack.decompress(self.frames[k]).decode()
        return self._last[1]

    def offset(self, unit: int) -> int:
        """Code points in the first ``unit`` units."""
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        if self.units[k] == unit:
            return self.chars[k]
        return self.chars[k] + int(unit_starts(self.text(k))[unit - self.units[k]])

    def stream(self, start: int, end: int) -> Iterator[str]:
        """Code points [start, end) by frames."""
        k = max(0, int(np.searchsorted(self.chars, start, "right")) - 1)
        while k < len(self.frames) and self.chars[k] < end:
            own = self.text(k)
            a, b = max(0, start - self.chars[k]), min(len(own), end - self.chars[k])
            if a < b:
                yield own[a:b]
            k += 1


def output(doc: Framed, form: str, first: int, second: int) -> Iterator[str]:
    """The output's pieces; the cuts are code points."""
    spans = {"prefix": (0, first), "middle": (first, second), "suffix": (second, doc.chars[-1])}
    if form == "plain":
        yield from doc.stream(0, doc.chars[-1])
    for part in ORDER.get(form, ()):
        yield MARKS[part]
        yield from doc.stream(*spans[part])


def parts(pieces: Iterable[str], form: str) -> Iterator[tuple[str, str]]:
    """(part, piece) of an output, told apart by its marks, which may lie across pieces."""
    order, at, rest = ORDER[form], -1, ""
    for piece in pieces:
        rest += piece
        while at + 1 < len(order) and (k := rest.find(MARKS[order[at + 1]])) >= 0:
            if k:
                yield order[at], rest[:k]
            rest, at = rest[k + 3 :], at + 1
        if len(rest) > 2:
            yield order[at], rest[:-2]
            rest = rest[-2:]
    if rest:
        yield order[at], rest


def restored(pieces: Iterable[str], form: str, pack: zstandard.ZstdCompressor, unpack: zstandard.ZstdDecompressor) -> Iterator[str]:
    """The text that an output was made of. Both orders put the suffix before the middle, so it waits, compressed."""
    if form == "plain":
        yield from pieces
        return
    held = []
    for part, piece in parts(pieces, form):
        if part == "suffix":
            held.append(pack.compress(piece.encode()))
        else:
            yield piece
    for x in held:
        yield unpack.decompress(x).decode()


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = FRAME) -> DataFrame:
    """(id, frames, units, chars, marked) of every row: its frames, the cumulative counts, and if it holds a mark."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                frames, units, chars = cut_frames(text or "", size)
                rows.append(([pack.compress(x.encode()) for x in frames], units, chars, any(m in text for m in MARKS.values()) if text else False))
            kinds = [pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "frames", "units", "chars", "marked"])

    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(framed, "id string, frames array<binary>, units array<long>, chars array<long>, marked boolean")


def drawn(id: Column, seed: str = "1") -> list[Column]:
    """Four numbers below 2^32 from the digest of the seed and the decimal id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id, F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(stored: DataFrame, texts: bool = False, seed: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), and ``output`` if ``texts`` are asked for.

    ``plain`` of 100 texts stay plain, and ``spm`` of 100 of the others begin with the suffix.
    """
    n = F.element_at("units", -1)
    h = drawn(F.col("id"), seed)
    form = F.when((n == 0) | F.col("marked") | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = stored.select("id", "frames", "units", "chars", form.alias("form"), F.least(h[0] % (n + 1), h[1] % (n + 1)).alias("lo"), F.greatest(h[0] % (n + 1), h[1] % (n + 1)).alias("hi"))

    def rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r in batch.drop_columns(["id"]).to_pylist():
                doc, form = Framed(r["frames"], r["units"], r["chars"], unpack), r["form"]
                a, b = (doc.offset(r["lo"]), doc.offset(r["hi"])) if form != "plain" else (0, 0)
                seen, again, kept = hashlib.sha256(), hashlib.sha256(), []

                def passing(doc=doc, form=form, a=a, b=b, seen=seen, kept=kept) -> Iterator[str]:
                    for piece in output(doc, form, a, b):
                        seen.update(piece.encode())
                        if texts:
                            kept.append(piece)
                        yield piece

                for piece in restored(passing(), form, pack, unpack):
                    again.update(piece.encode())
                cuts = (None, None) if form == "plain" else (a, b - a)
                out.append((r["units"][-1], form, *cuts, seen.hexdigest(), again.hexdigest(), "".join(kept) if texts else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"])

    done = rows.mapInArrow(rearranged, "id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string")
    return done if texts else done.drop("output")
