"""Runs: maximal stretches of words that repeat with a smallest period, by enumeration of maximal pairs.

A pair of positions (i, j), i < j, is maximal with length L if L words from both are equal, the words before them
differ (or i is the text's first word) and the words after the L differ (or the text ends). The suffixes' LCP-interval
tree is walked bottom-up. Each node has its positions in order, each in the class of its left word; where a child joins
its parent at depth L, every position of the smaller list looks for its two neighbours in the joint one, and the pairs
across lists and classes are maximal. So positions move O(n log n) times.

Neighbours are enough. Let a stretch from i have smallest period q and length L + q >= 2 q. A position of the same L
words between i and i + q would give a smaller period, so i and i + q are neighbours. If two neighbours i, j have distance d and the
stretch has a smaller period p, then p divides d (Fine and Wilf) and i + p lies in i's child between them, which
contradicts. So the maximal pairs that keep the length constraint are exactly the runs, and no pair is extended.

Defined results: a null text has no words and no run; texts without a repeated stretch have an empty list. Rows with
equal ids are rows of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the shortest run, and the least number of periods in one.
LEAST = 6
PERIODS = 4
#: Positions in a piece of a node's list.
PIECE = 512

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def least_common(least: int = LEAST, periods: int = PERIODS) -> int:
    """Length of the shortest pair that can be a run."""
    return min(max(least - q, (periods - 1) * q) for q in range(1, least + 1))


def may_repeat(words: np.ndarray, size: int) -> bool:
    """False only if no ``size`` words in a row occur twice."""
    n = len(words) - size + 1
    if n < 2:
        return False
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed ^ words[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common length of each with the next, by doubling."""
    n = len(words)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int32) + 1]  # 0 is the text's end
    size = 1
    while size < n and int(ranks[-1].max()) < n:
        key = ranks[-1].astype(np.int64) * (n + 1)
        key[: n - size] += ranks[-1][size:]
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32) + 1)
        size *= 2
    order = np.empty(n, np.int64)
    order[ranks[-1] - 1] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        own = np.append(ranks[k], np.int32(0))
        same = (a < n) & (b < n)
        same &= own[np.minimum(a, n)] == own[np.minimum(b, n)]
        step = same * (1 << k)
        a, b, common = a + step, b + step, common + step
    return order, common


def _neighbours(node: list[list[int]], x: int) -> tuple[int, int]:
    """The positions before and after ``x`` (-1: none), which isn't in the list."""
    p = 0 if len(node) == 1 else max(0, bisect_left(node, x, key=lambda piece: piece[0]) - 1)
    piece = node[p]
    k = bisect_left(piece, x)
    before = piece[k - 1] if k else -1  # only in the first piece is x before all
    after = piece[k] if k < len(piece) else node[p + 1][0] if p + 1 < len(node) else -1
    return before, after


def _insert(node: list[list[int]], x: int) -> None:
    p = 0 if len(node) == 1 else max(0, bisect_left(node, x, key=lambda piece: piece[0]) - 1)
    piece = node[p]
    piece.insert(bisect_left(piece, x), x)
    if len(piece) > 2 * PIECE:
        node[p : p + 1] = [piece[:PIECE], piece[PIECE:]]


def runs(words: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. ``words``: numbers, equal for equal words."""
    floor = least_common(least, periods)
    if not may_repeat(words, floor):
        return []
    order, common = suffixes(words)
    left = [-1, *words.tolist()[:-1]]  # no word has the number -1
    found: list[tuple[int, int, int]] = []

    def joined(one: list[list[int]], two: list[list[int]], depth: int) -> list[list[int]]:
        """Both lists in one; the maximal pairs between them that are runs."""
        big, small = (one, two) if sum(map(len, one)) >= sum(map(len, two)) else (two, one)
        far = depth // (periods - 1)
        moved = small[0] if len(small) == 1 else list(chain.from_iterable(small))
        for x, following in zip(moved, chain(moved[1:], [len(left)])):
            before, after = _neighbours(big, x)
            if before >= 0 and x - before <= far and left[x] != left[before] and depth + x - before >= least:
                found.append((before, depth + x - before, x - before))
            if 0 <= after < following and after - x <= far and left[x] != left[after] and depth + after - x >= least:
                found.append((x, depth + after - x, after - x))
        for x in moved:
            _insert(big, x)
        return big

    deep = np.flatnonzero(common >= floor)
    open_: list[tuple[int, list[list[int]]]] = []  # intervals that later suffixes may join, the deepest last
    last = -2
    for k, position, depth in zip(deep.tolist(), order[deep].tolist(), common[deep].tolist()):
        if k != last + 1 and open_:
            _close(open_, [[int(order[last + 1])]], 0, joined)
        last = k
        node = _close(open_, [[position]], depth, joined)
        open_.append((depth, node))
    if open_:
        _close(open_, [[int(order[last + 1])]], 0, joined)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _close(open_: list[tuple[int, list[list[int]]]], node: list[list[int]], depth: int, joined) -> list[list[int]]:
    """``node`` joins the open intervals of at least ``depth``, the deepest first."""
    while open_ and open_[-1][0] >= depth:
        d, own = open_.pop()
        node = joined(own, node, d)
    return node


def numbered(words: list[bytes]) -> np.ndarray:
    """Numbers that are equal for equal words."""
    index: dict[bytes, int] = {}
    return np.fromiter(map(index.setdefault, words, range(len(words))), np.int64, len(words))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """False for the words of a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs, and its words without their repetitions, joined by one space."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").split()  # of bytes: at U+0009 to U+000D and the space
                found = runs(numbered(words), least, periods)
                if found:
                    words_kept = [w for w, k in zip(words, kept(len(words), found).tolist()) if k]
                else:
                    words_kept = words
                counts.append(len(words))
                lists.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(words_kept).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(lists, kind), pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(searched, f"id long, n_words long, runs {RUNS}, collapsed string")
