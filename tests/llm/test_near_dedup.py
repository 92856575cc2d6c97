import random
from collections import Counter

import numpy as np
import pytest
from tessera.llm import near_dedup as N

from .support import awkward, documents, prose


def sets(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    w = [x for x in w if x]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def brute(rows):
    s = [sets(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return Counter((r[0], len(s[i]), low.get(root(i)), r[0] == low.get(root(i))) for i, r in enumerate(rows))


def changed(text, share, seed):
    rng = random.Random(seed)
    return " ".join("x" + w if rng.random() < share else w for w in text.split(" "))


def corpus():
    rows = awkward()
    for g in range(6):  # families around the threshold, one after the other changed again
        base = prose(g, 120)
        for k in range(8):
            rows.append((1000 + 100 * g + k, base, "en", "a"))
            base = changed(base, 0.01 * (g + 1), 31 * g + k)
    hot = prose(77, 100)
    rows += [(3000 + i, changed(hot, 0.005 * (i % 12), i), "en", "a") for i in range(240)]
    rows += [(3300 + i, " ".join(hot.split()[: 40 + i]), "en", "a") for i in range(60)]
    rows += [(4000 + i, prose(500 + i, 3 + i % 5), "en", "b") for i in range(30)]
    shared = prose(88, 60)
    return rows + [(5000 + i, prose(900 + i, 150) + " " + shared, "en", "c") for i in range(40)]


def test_groups_equal_brute_force(spark):
    rows = corpus()
    got = N.near_groups(documents(spark, rows).repartition(4)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_drop_keeps_one_of_each_group(spark):
    rows = [r for r in corpus() if r[0] not in (None, 14) and r[0] < 3200]  # 14 stands for two texts
    df = documents(spark, rows)
    got = N.drop_near_copies(df)
    assert got.columns == df.columns
    ids = Counter(r.doc_id for r in got.collect())
    want = Counter({k[2] for k in brute(rows) if k[1]}) + Counter(r[0] for r in rows if not sets(r[1]))
    assert ids == want


def test_empty_table(spark):
    assert N.near_groups(documents(spark, [])).collect() == []


def test_registers_merge_and_estimate():
    s = N.Sketch()
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:700], rng.integers(0, 2**63, 300).astype(np.uint64)]))
    both = np.union1d(a, b)
    ra, rb, rab = N.registers([a, b, both], s)
    assert (np.maximum(ra, rb) == rab).all()
    best, evidence = N.against(ra[None], rb[None], np.array([float(len(a))]), np.array([float(len(b))]), s)
    assert abs(best[0] - 700 / len(both)) < 0.15
    assert (N.registers([a[:3], a], s)[0] <= ra).all()  # a larger set has larger registers
    one = N.registers([a], s)[0]
    assert (one == ra).all()  # a set's registers don't depend on what is sketched with it


def test_far_sets_are_ruled_out():
    s = N.Sketch()
    rng = np.random.default_rng(6)
    a, b = (np.unique(rng.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(2))
    ra, rb = N.registers([a, b], s)
    assert N.against(ra[None], rb[None], np.array([500.0]), np.array([500.0]), s)[1][0] > s.sure
    assert N.against(ra[None], ra[None], np.array([500.0]), np.array([500.0]), s)[1][0] == 0


def test_components(spark):
    links = [(1, 2), (3, 2), (4, 3), (10, 11), (12, 11), (20, 21), (5, 4), (30, 29), (29, 28), (28, 27), (27, 26), (7, 7)]
    got = {r.node: r.comp for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20, **{i: 26 for i in range(26, 31)}}


def family(n, seed=3):
    """Copies of one text, each with its own share of changed words; nearly half are too far from the text to be linked with it."""
    words, rows = prose(41, 150).split(), []
    for i in range(n):
        rng = random.Random(7 * i + seed)
        share = 0.001 * (i % 60) if i else 0
        rows.append((i, " ".join(prose(rng.random(), 1) if rng.random() < share else w for w in words), "en", "a"))
    return rows


def test_meeting_pairs_hold_every_link(spark):
    """All sets meet by their rarest shingles only: every link between different components is among the pairs."""
    s = N.Sketch()
    texts = [r[1] for r in corpus() if r[1] and len(r[1]) < 20000] + [r[1] for r in family(150)]
    found = sorted({N.shingles(t.encode(), 5).tobytes() for t in texts} - {b""})
    got = [set(np.frombuffer(x, np.uint64).tolist()) for x in found]
    comp = [i % 7 if i % 3 else 0 for i in range(len(found))]
    sets_ = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(found)], "class long, shingles binary")
    members = spark.createDataFrame(list(enumerate(comp)), "class long, comp long")
    pairs = {tuple(r) for r in N._meeting(members, sets_, s).collect()}
    links = {(i, j) for i in range(len(got)) for j in range(i) if comp[i] != comp[j] and 100 * len(got[i] & got[j]) >= 75 * len(got[i] | got[j])}
    assert links and links <= pairs
    assert all(comp[a] != comp[b] and a > b for a, b in pairs)


def test_compared_pairs_grow_with_the_family_not_its_square(spark, monkeypatch):
    compared = []
    plain = N._possible
    monkeypatch.setattr(N, "_possible", lambda pairs, classes, s: compared.append(pairs.count()) or plain(pairs, classes, s))
    each = []
    for n in (400, 800, 1600):
        compared.clear()
        rows = family(n)
        got = N.near_groups(documents(spark, rows, extra=False).repartition(4)).collect()
        each.append(sum(compared) / n)
        if n < 1000:
            assert Counter(tuple(r) for r in got) == brute(rows)
    assert each[2] < 1.5 * each[0] and each[2] < 16


@pytest.mark.xfail(reason="changes that recur in many texts: 14.4 compared pairs per text at 400, 47.2 at 1,600 (README)")
def test_compared_pairs_with_recurring_changes(spark, monkeypatch):
    """A changed word always becomes the same other word."""
    compared = []
    plain = N._possible
    monkeypatch.setattr(N, "_possible", lambda pairs, classes, s: compared.append(pairs.count()) or plain(pairs, classes, s))
    base, each = prose(41, 150), []
    for n in (400, 1600):
        compared.clear()
        rows = [(i, changed(base, 0.001 * (i % 60), 7 * i + 3) if i else base, "en", "a") for i in range(n)]
        N.near_groups(documents(spark, rows, extra=False).repartition(4)).collect()
        each.append(sum(compared) / n)
    assert each[1] < 1.5 * each[0]
