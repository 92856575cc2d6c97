from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tessera.llm import mixing

from .support import awkward, documents, prose


def level(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted((n for n in sizes if n is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    got, open_, rest = {n: 0.0 for n in names}, set(names), share * sum(sizes.values())
    while open_ and rest > 1e-9:
        total, left = sum(w[n] for n in open_), rest
        for n in sorted(open_, key=str):
            part = min(left * w[n] / total, most * sizes[n] - got[n])
            got[n] += part
            rest -= part
            if got[n] >= most * sizes[n] - 1e-9:
                open_.discard(n)
    return got


def corpus():
    rows = awkward() + [(100 + i, prose(i, 20 + i % 50), "en", "src%d" % (i % 7 if i % 3 else 0)) for i in range(400)]
    return rows + [(900 + i, prose(i, 3000), "en", "big") for i in range(4)]


@pytest.fixture(scope="module")
def mixed(spark):
    df = documents(spark, corpus()).repartition(3)
    return df, mixing.mix(df, block=32, shard=64, whole=True)


def test_taken_meets_targets(spark, mixed):
    df, m = mixed
    got = mixing.taken(m).collect()
    rows = corpus()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len((r[1] or "").replace("\x0b", " ").replace("\x0c", " ").encode().split())
    want = {n: t for n, t in level(size).items()}
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[(r.source_size, round(r.target, 3))].append(r)
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(size.values()), abs=len(size))
    found = Counter((s, t) for s, t in by)
    assert found == Counter({(size[n], round(want[n], 3)): 1 for n in want}) or set(found) == {(size[n], round(want[n], 3)) for n in want}
    for (s, t), members in by.items():
        many = sum(1 for n in want if (size[n], round(want[n], 3)) == (s, t))
        assert abs(sum(r["taken"] for r in members) - many * t) <= many


def test_slots_are_multinomial_draws_settled_to_quotas(spark, mixed):
    _, m = mixed
    quota = {r["rank"]: r.quota for r in m.sources.collect()}
    slots = m.slots.collect()
    assert Counter(s.source_rank for s in slots) == Counter({k: v for k, v in quota.items() if v})
    assert sorted(s.slot for s in slots) == list(range(sum(quota.values())))
    for rank in quota:
        assert sorted(s.k for s in slots if s.source_rank == rank) == list(range(quota[rank]))
    assert max(Counter((s.source_rank, s.block) for s in slots).values()) <= 2
    assert max(s.shard for s in slots) == (len(slots) - 1) // 64


def test_reruns_agree(spark):
    rows = [(100 + i, prose(i, 20 + i % 50), "en", "src%d" % (i % 5)) for i in range(200)]  # whatever the partitions
    a, b = (sorted(map(tuple, mixing.taken(mixing.mix(documents(spark, rows).repartition(n), block=32, shard=64)).collect())) for n in (2, 5))
    assert a == b


def test_texts_hold_what_is_taken(spark, mixed):
    df, m = mixed
    out = mixing.mixed_texts(m, df.columns)
    assert out.columns == df.columns
    rows = out.collect()
    own = defaultdict(set)
    for r in corpus():
        own[r[0]].add(r[1])
    n = Counter()
    for r in rows:
        words = r.text.split()
        assert words and r.n_chars == len(r.text)
        n[r.doc_id] += len(words)
        assert any(t and set(words) <= set(t.split()) for t in own[r.doc_id])
    want = Counter()
    for r in mixing.taken(m).collect():
        if r["taken"]:
            want[r.id] += r["taken"]
    odd = {8, 13}  # no-break spaces and control characters, which str.split() would split
    assert {k: v for k, v in n.items() if k not in odd} == {k: v for k, v in want.items() if k not in odd}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100, 1000])
def test_permutation(spark, n):
    at = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p"), "id")
    got = [r.p for r in at.orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    if n > 50:
        assert sum(abs(a - b) == 1 for a, b in zip(got, got[1:])) < n / 5


def test_empty_tables(spark):
    assert mixing.taken(mixing.mix(documents(spark, []))).collect() == []
    df = documents(spark, [(1, None, "en", "a"), (2, " ", "en", None)])
    assert [r["taken"] for r in mixing.taken(mixing.mix(df)).collect()] == [0, 0]
    assert mixing.mixed_texts(mixing.mix(df, whole=True), df.columns).collect() == []
