import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import periodic, suite

from .support import awkward, documents, prose


def brute(words, least=6, periods=4):
    """By the definition: for every period, the maximal stretches; the smallest period of each."""
    best = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def cases():
    rng = random.Random(5)
    for n in range(40):
        yield [rng.choice("ab") for _ in range(n)]
    for seed in range(150):
        out = []
        while len(out) < rng.randint(0, 150):
            unit = [rng.choice("abcde") for _ in range(rng.randint(1, 9))]
            out += (unit * rng.randint(1, 9))[: rng.randint(1, 60)]
        yield out
    yield list("a" * 700)
    yield list("ab" * 400)
    yield list("aabaab" * 80 + "b" + "aabaab" * 50)
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    yield list(fib[-1])
    yield [w for k in range(300) for w in (f"n{k}", "the", "same", "five", "words", "again")]


@pytest.mark.parametrize("least, periods", [(6, 4), (2, 2), (9, 3), (1, 5)])
def test_runs_equal_brute_force(least, periods):
    for words in cases():
        got = periodic.runs(periodic.numbered([w.encode() for w in words]), least, periods)
        assert got == brute(words, least, periods), words


def test_suffixes_and_common_lengths():
    for words in cases():
        if not words:
            continue
        numbers = periodic.numbered([w.encode() for w in words])
        order, common = periodic.suffixes(numbers)
        suffix = [numbers[i:].tolist() for i in order]
        assert suffix == sorted(suffix)
        for a, b, n in zip(suffix, suffix[1:], common):
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1]


def test_positions_move_seldom(monkeypatch):
    """Smaller lists move: n log n, also for one word repeated."""
    moves = []
    monkeypatch.setattr(periodic, "_insert", lambda node, x, f=periodic._insert: (moves.append(x), f(node, x)))
    for n in (2000, 8000):
        for words in (np.zeros(n, np.int64), np.arange(n) % 7):
            moves.clear()
            assert len(periodic.runs(words)) == 1
            assert len(moves) <= n * np.log2(n)


def test_table(spark):
    rows = awkward() + [(200, "x " * 50, "en", "a"), (200, "x " * 50, "en", "a"), (201, prose(3, 40) + "\n" + "é ß \xa0 ü\t" * 30, "en", "a")]
    got = {(r.id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periodic.find(documents(spark, rows)).collect()}
    want = set()
    for doc_id, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        found = brute(words) if len(words) < 5000 else []
        keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
        want.add((doc_id, len(words), tuple(found), " ".join(keep)))
    assert got == want
    assert periodic.find(documents(spark, [])).collect() == []


def test_replanted_texts(spark):
    rows = [(i, prose(i, i % 30), "en", "a") for i in range(300)] + [(None, "a b", "en", "a"), (301, None, "en", "a")]
    got = {r.doc_id: r.text for r in suite.replanted(documents(spark, rows).select("doc_id", "text")).collect()}
    changed = 0
    for doc_id, text, *_ in rows:
        words = (text or "").split()
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
            changed += 1
        assert got[doc_id] == text
    assert changed > 10


def test_query_of_an_empty_table(spark, tmp_path):
    documents(spark, [], extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("op11_prefix_polynomial_fingerprint", "op12_seekable_frame_fim", "op13_maximal_pair_runs"):
        assert suite.QUERIES[name](spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
