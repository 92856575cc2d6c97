"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for every position, the polynomial hash of the code points before it, modulo two primes.
Two entries give the hash of any span, so spans of two texts are compared in constant time, and the longest common
extension of two positions is found by binary search. A prefix array of a text put together from parts is put together
from theirs.

A fingerprint is a prefix array thinned out: its entries at the text's landmarks, at 0 and at the end. Landmarks are the
positions of the ``LANDMARKS`` smallest window hashes (first position of each), so texts with a common passage have
landmarks in common, and its size doesn't grow with the text. Two fingerprints answer if the spans between
their common landmarks are equal; likeness is the share of both texts that such spans cover: common landmarks lie on
diagonals (same distance between the two positions), and on each diagonal binary search extends a span as far as it
goes. A landmark alone covers its window. Equal texts have equal fingerprints and likeness 1.

Neighbours: texts are dealt to chunks by id, once, and streamed in descending order. The chunks' borders are ids that
occur, so the row that follows a chunk's last one is known beforehand and is sent there as a guest.

Defined results: a null text counts as empty. Null ids come last in descending order; rows with equal ids follow each
other by the hash of their texts. After the last row comes the first; a table of one row is its own neighbour. Two empty texts
have likeness 1, an empty and another one 0. A text shorter than a window has no landmarks but its ends. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Moduli (two primes below 2^31, so that products fit 64 bits) and bases.
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1664525191)
#: Code points of a landmark's window, and landmarks of a fingerprint.
WINDOW = 8
LANDMARKS = 32
#: Code points of a chunk of neighbours, and the most chunks.
CHUNK = 1 << 22
MOST_CHUNKS = 20_000

_NONE = 0xFFFFFFFF


class _Powers:
    """Powers of a base and of its inverse, as far as needed so far."""

    def __init__(self, base: int, modulus: int):
        self.modulus = modulus
        self.steps = (base, pow(base, -1, modulus))
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            up, down = (pow(s, size, self.modulus) for s in self.steps)
            self.up = np.concatenate([self.up, self.up * np.uint64(up) % np.uint64(self.modulus)])
            self.down = np.concatenate([self.down, self.down * np.uint64(down) % np.uint64(self.modulus)])


_POWERS = [_Powers(b, m) for b, m in zip(BASES, MODULI)]


class Prefixes:
    """The prefix arrays of a text, and the hashes of its windows."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for p in _POWERS:
            p.grow(self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * p.up[: self.n] % np.uint64(p.modulus), out=sums[1:])
            self.sums.append(sums % np.uint64(p.modulus))
        self.windows = window_hashes(self.sums[0], 0)

    def at(self, where: np.ndarray) -> list[np.ndarray]:
        """Entries of both arrays."""
        return [s[where] for s in self.sums]

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hash of code points [start, end), wherever they stand."""
        return tuple((int(s[end]) - int(s[start])) * int(p.down[start]) % p.modulus for s, p in zip(self.sums, _POWERS))

    def extension(self, start: int, other: Prefixes, other_start: int) -> int:
        """Code points that both texts have in common from these positions on."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            half = (low + high + 1) // 2
            if self.span(start, start + half) == other.span(other_start, other_start + half):
                low = half
            else:
                high = half - 1
        return low


def window_hashes(sums: np.ndarray, first: int) -> np.ndarray:
    """Hashes of the windows of a part of a prefix array that begins at ``first`` (of the first modulus)."""
    p, n = _POWERS[0], len(sums) - WINDOW
    if n <= 0:
        return np.empty(0, np.uint64)
    m = np.uint64(p.modulus)
    return (sums[WINDOW:] + m - sums[:-WINDOW]) % m * p.down[first : first + n] % m


class Joined:
    """The first ``keep`` code points of a text and the first ``add`` of another, from the prefix arrays of both."""

    def __init__(self, one: Prefixes, keep: int, two: Prefixes, add: int):
        self.one, self.keep, self.two, self.add, self.n = one, keep, two, add, keep + add
        for p in _POWERS:
            p.grow(self.n + 1)
        a, b = max(0, keep - WINDOW + 1), max(0, add - WINDOW + 1)
        last = min(keep + WINDOW - 1, self.n)
        seam = window_hashes(self.at(np.arange(a, last + 1))[0], a)
        self.windows = np.concatenate([one.windows[:a], seam, two.windows[:b]])

    def at(self, where: np.ndarray) -> list[np.ndarray]:
        inside = where <= self.keep
        out = []
        for s, t, p in zip(self.one.sums, self.two.sums, _POWERS):
            far = (s[self.keep] + p.up[self.keep] * t[np.where(inside, 0, where - self.keep)]) % np.uint64(p.modulus)
            out.append(np.where(inside, s[np.minimum(where, self.keep)], far))
        return out


class Fingerprint:
    """Thinned prefix arrays: ``key``, ``position`` and the two entries of each landmark, by position, then the end."""

    def __init__(self, n: int, keys: list[int], positions: list[int], sums: list[list[int]]):
        self.n, self.keys, self.positions, self.sums = n, keys, positions, sums

    @classmethod
    def of(cls, text: Prefixes | Joined) -> Fingerprint:
        windows = text.windows
        share = 4 * LANDMARKS / max(1, len(windows))
        while True:
            few = np.flatnonzero(windows < np.uint64(share * MODULI[0])) if share < 1 else np.arange(len(windows))
            keys, first = np.unique(windows[few], return_index=True)
            if len(keys) >= LANDMARKS or share >= 1:
                break
            share *= 4
        keys, where = keys[:LANDMARKS], few[first[:LANDMARKS]]
        order = np.argsort(where)
        where = np.append(where[order], text.n)
        return cls(text.n, [*keys[order].tolist(), _NONE], where.tolist(), [s.tolist() for s in text.at(where)])

    def __str__(self) -> str:
        rows = np.array([self.positions, self.keys, *self.sums], "<u4")
        return base64.b64encode(rows.tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        positions, keys, *sums = np.frombuffer(base64.b64decode(text), "<u4").reshape(4, -1).tolist()
        return cls(positions[-1], keys, positions, sums)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of both texts that equal spans between common landmarks cover."""
    if not a.n or not b.n:
        return float(a.n == b.n)
    full = [max(x.keys[:-1]) for x in (a, b) if len(x.keys) > LANDMARKS]
    limit = min(full, default=_NONE)  # both have all landmarks up to here
    there = {k: i for i, k in enumerate(b.keys) if k <= limit}
    diagonals: dict[int, list[tuple[int, ...]]] = defaultdict(list)  # (position in a, entries of a, entries of b, window)
    diagonals[0].append((0, 0, 0, 0, 0, 0))
    ends = (len(a.keys) - 1, len(b.keys) - 1)
    for i, j in chain(((i, there[k]) for i, k in enumerate(a.keys[:-1]) if k in there), [ends]):
        x = a.positions[i]
        diagonals[b.positions[j] - x].append((x, a.sums[0][i], a.sums[1][i], b.sums[0][j], b.sums[1][j], WINDOW if i < ends[0] else 0))
    spans = ([], [])
    for shift, found in diagonals.items():
        up = [pow(base, shift, m) for base, m in zip(BASES, MODULI)]
        at = 0
        while at < len(found):
            here, low, high = found[at], at, len(found) - 1
            while low < high:
                half = (low + high + 1) // 2
                there_ = found[half]
                same = all(((there_[1 + k] - here[1 + k]) * up[k] - there_[3 + k] + here[3 + k]) % MODULI[k] == 0 for k in (0, 1))
                low, high = (half, high) if same else (low, half - 1)
            start, end = here[0], found[low][0] + found[low][5]
            spans[0].append((start, end))
            spans[1].append((start + shift, end + shift))
            at = low + 1
    return sum(_covered(x) for x in spans) / (a.n + b.n)


def _covered(spans: list[tuple[int, int]]) -> int:
    total = reach = 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Fingerprint.of(Prefixes(x or "")) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([f.n for f in found], pa.int64()), pa.array([str(f) for f in found], pa.string())], ["id", "n_chars", "fingerprint"])

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(made, T.StructType([
        T.StructField("id", df.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())]))


def _targets(id: Column, ends: list[int]) -> Column:
    """(chunk, guest) of a row: its own chunk, and for the first row of one also the next above (or the lowest)."""
    if len(ends) < 2:
        return F.array(F.struct(F.lit(0).alias("chunk"), F.lit(False).alias("guest")))
    borders = np.array(ends)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        """The number of the chunk, negative (-1 - chunk) for its first row."""
        at = np.minimum(np.searchsorted(borders, ids.to_numpy()), len(borders) - 1)
        return pd.Series(np.where(borders[at] == ids.to_numpy(), -1 - at, at).astype("int32"))

    code = F.when(id.isNull(), 0).otherwise(place(F.coalesce(id, F.lit(int(borders[0])))))
    return F.transform(F.array(code), lambda c: F.when(
        c < 0, F.array(F.struct((-1 - c).alias("chunk"), F.lit(False).alias("guest")), F.struct((-c % len(borders)).cast("int").alias("chunk"), F.lit(True).alias("guest"))),
    ).otherwise(F.array(F.struct(c.alias("chunk"), F.lit(False).alias("guest")))))[0]


def neighbour_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Every text against itself with its last third replaced by the beginning of the next text, by descending id.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_next): ``common_next`` is the
    number of code points with which both texts begin.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = min(MOST_CHUNKS, chars // chunk + 1)
    ends = []
    if n > 1:
        # Ids that occur: n shares of the rows, and the largest one.
        q = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("q"), F.max("id").alias("top")).first()
        ends = sorted({*(q["q"] or []), *([q["top"]] if q["top"] is not None else [])})
    alone = len(ends) < 2  # one chunk: its own first row follows its last

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None  # (id, text, prefixes, fingerprint) of the row before and of the first one
        now = None
        out: list[tuple] = []
        size = 0

        def put(own, other) -> None:
            nonlocal size
            id, text, prefixes, print_ = own
            third = prefixes.n // 3
            keep, add = prefixes.n - third, min(third, other[2].n)
            edited = Fingerprint.of(Joined(prefixes, keep, other[2], add)) if third else print_
            digest = hashlib.sha256((text[:keep] + other[1][:add]).encode()).hexdigest()
            out.append((id, prefixes.n, digest, str(print_), str(edited), likeness(print_, edited), likeness(print_, other[3]), prefixes.extension(0, other[2], 0)))
            size += 1

        for batch in batches:
            for c, guest, id, text in zip(*(batch.column(k).to_pylist() for k in ("chunk", "guest", "id", "text"))):
                if c != now:
                    if alone and last is not None:
                        put(last, first)
                    now, last, first = c, None, None
                if guest and last is None:  # a second guest, or a chunk without rows
                    continue
                prefixes = Prefixes(text)
                row = (id, text, prefixes, Fingerprint.of(prefixes))
                first = first or row
                if last is not None:
                    put(last, row)
                last = None if guest else row
            if size >= 256:
                yield _result(out)
                out, size = [], 0
        if alone and last is not None:
            put(last, first)
        if out:
            yield _result(out)

    placed = rows.select("id", "text", F.explode(_targets(F.col("id"), ends)).alias("to")).select("to.chunk", "to.guest", "id", "text")
    order = ["chunk", "guest", F.desc_nulls_last("id"), F.xxhash64("text")]
    dealt = placed.repartition("chunk").sortWithinPartitions(*order)
    return dealt.mapInArrow(streamed, ", ".join(f"{k} {t}" for k, t in _COLUMNS))


_COLUMNS = [("id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"),
            ("near_edited", "double"), ("near_next", "double"), ("common_next", "long")]


def _result(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[t]) for k, (_, t) in enumerate(_COLUMNS)], [k for k, _ in _COLUMNS])
