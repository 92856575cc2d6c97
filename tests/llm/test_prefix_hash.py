import hashlib
import math
import random

import numpy as np
import pytest
from tessera.llm import prefix_hash as ph

from .support import awkward, documents, prose


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def window_hash(text, i):
    return sum((ord(c) + 1) * pow(ph.BASES[0], k, ph.MODULI[0]) for k, c in enumerate(text[i : i + ph.WINDOW])) % ph.MODULI[0]


def marks(text):
    """{window hash: first position} of the smallest hashes, by the definition."""
    first = {}
    for i in range(len(text) - ph.WINDOW + 1):
        first.setdefault(window_hash(text, i), i)
    return {k: first[k] for k in sorted(first)[: ph.LANDMARKS]}


def brute_likeness(a, b):
    """Spans are compared as texts, and extended one landmark at a time."""
    if not a or not b:
        return float(a == b)
    own, other = marks(a), marks(b)
    limit = min((max(m) for m in (own, other) if len(m) == ph.LANDMARKS), default=math.inf)
    pairs = sorted([(own[k], other[k], ph.WINDOW) for k in own if k in other and k <= limit] + [(0, 0, -1)]) + [(len(a), len(b), 0)]
    pairs = [(x, y, max(w, 0)) for x, y, w in pairs]
    in_a, in_b = set(), set()
    for shift in {y - x for x, y, _ in pairs}:
        found = [(x, w) for x, y, w in pairs if y - x == shift]
        at = 0
        while at < len(found):
            x = found[at][0]
            to = at
            while to + 1 < len(found) and a[x : found[to + 1][0]] == b[x + shift : found[to + 1][0] + shift]:
                to += 1
            in_a |= set(range(x, found[to][0] + found[to][1]))
            in_b |= set(range(x + shift, found[to][0] + found[to][1] + shift))
            at = to + 1
    return (len(in_a) + len(in_b)) / (len(a) + len(b))


def test_spans_and_extensions():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab😀") for _ in range(n)) for n in (0, 1, 5, 60, 300)] + ["a" * 100, prose(1, 200)]
    made = [ph.Prefixes(t) for t in texts]
    for a, p in zip(texts, made):
        for b, q in zip(texts, made):
            for _ in range(40):
                i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
                assert p.extension(i, q, j) == common(a[i:], b[j:])
                n = rng.randint(0, min(len(a) - i, len(b) - j))
                assert (p.span(i, i + n) == q.span(j, j + n)) == (a[i : i + n] == b[j : j + n])


def test_joined_arrays_are_those_of_the_joined_text():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcdé😀") for _ in range(rng.randint(0, 40))) for _ in "ab")
        keep, add = rng.randint(0, len(a)), rng.randint(0, len(b))
        joined, whole = ph.Joined(ph.Prefixes(a), keep, ph.Prefixes(b), add), ph.Prefixes(a[:keep] + b[:add])
        assert joined.windows.tolist() == whole.windows.tolist()
        assert [x.tolist() for x in joined.at(np.arange(whole.n + 1))] == [x.tolist() for x in whole.sums]


def test_likeness_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.choice([prose(rng.randint(0, 9), rng.randint(0, 120)), "ab" * rng.randint(0, 60), "x" * rng.randint(0, 99)])
        cut = rng.randint(0, len(a))
        b = rng.choice([a, a[cut:] + a[:cut], a[:cut] + "Q" + a[cut:], a[:cut] + prose(50, 30), prose(51, 20)])
        x, y = (ph.Fingerprint.of(ph.Prefixes(t)) for t in (a, b))
        assert ph.likeness(x, y) == pytest.approx(brute_likeness(a, b), abs=1e-12), (a, b)
        assert str(ph.Fingerprint.parse(str(x))) == str(x)
        assert ph.likeness(ph.Fingerprint.parse(str(x)), ph.Fingerprint.parse(str(y))) == ph.likeness(x, y)
        if a == b:
            assert str(x) == str(y) and ph.likeness(x, y) == 1


def brute_rows(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (doc_id, text, *_) in enumerate(ordered):
        a, b = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(a) // 3
        edited = a[: len(a) - third] + b[:third]
        near = [1.0 if a == x else brute_likeness(a, x) for x in (edited, b)]
        prints = [str(ph.Fingerprint.of(ph.Prefixes(x))) for x in (a, edited)]
        out.append((doc_id, len(a), hashlib.sha256(edited.encode()).hexdigest(), *prints, *(round(x, 9) for x in near), common(a, b)))
    return sorted(out, key=str)


def rounded(found):
    return sorted(((*r[:5], round(r.near_edited, 9), round(r.near_next, 9), r.common_next) for r in found), key=str)


@pytest.mark.parametrize("chunk", [50, 700, 1 << 22])
def test_rows_equal_brute_force(spark, chunk):
    texts = [prose(k % 13, 3 + 7 * (k % 11)) for k in range(80)] + ["", "a", "abcdefgh", "é😀" * 9, None, "x" * 400, "x" * 400]
    rows = [(3 * k - 60, t, "en", "a") for k, t in enumerate(texts)] + [(None, "no id", "en", "a"), (10**15, prose(77, 50), "en", "a")]
    random.Random(4).shuffle(rows)
    got = ph.neighbour_edits(documents(spark, rows).repartition(5), chunk=chunk).collect()
    assert rounded(got) == brute_rows(rows)


def test_awkward_rows(spark):
    """Ties in the id, repeated rows and long texts: every row comes, equal ids follow each other."""
    rows = awkward()
    for chunk in (20, 1 << 22):
        got = ph.neighbour_edits(documents(spark, rows), chunk=chunk).collect()
        assert sorted(str(r.id) for r in got) == sorted(str(r[0]) for r in rows)
        assert sorted(r.n_chars for r in got) == sorted(len(r[1] or "") for r in rows)
    assert ph.neighbour_edits(documents(spark, [])).collect() == []
    alone = ph.neighbour_edits(documents(spark, [(1, "a b c d e f", "en", "a")])).collect()
    assert [(r.id, r.near_next, r.common_next) for r in alone] == [(1, 1.0, 11)]


def test_fingerprints_of_a_table(spark):
    got = {(r.id, r.fingerprint) for r in ph.fingerprints(documents(spark, awkward())).collect()}
    assert got == {(r[0], str(ph.Fingerprint.of(ph.Prefixes(r[1] or "")))) for r in awkward()}
    assert max(len(f) for _, f in got) <= 16 * (ph.LANDMARKS + 1) * 4 / 3 + 4
