import hashlib
import re
from collections import Counter, defaultdict

import pytest
from tessera.llm import exact_dedup

from .support import awkward, documents


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, i, doc_id))
    out = []
    for norm, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out.append((m[4], members[0][4], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("counters", [1, 3, 1023])
def test_groups_equal_brute_force(spark, counters):
    rows = awkward() + [(100 + i, "hot text", "en", "a") for i in range(300)] + [(1000 + i, f"own text {i % 90}", "en", "a") for i in range(200)]
    got = exact_dedup.exact_groups(documents(spark, rows).repartition(5), counters=counters).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_misra_gries_finds_frequent_values(spark):
    values = [b"a"] * 500 + [b"b"] * 300 + [bytes([i % 250, i // 250, 7]) for i in range(900)]
    df = spark.createDataFrame([(v,) for v in values], "v binary").repartition(4)
    k = 9
    got = {bytes(r[0]): r[1] for r in exact_dedup.misra_gries(df, "v", k).collect()}
    for v, n in Counter(values).items():
        assert n - len(values) / (k + 1) <= got.get(v, 0) <= n


def test_drop_copies_keeps_rows_whole(spark):
    rows = awkward() + [(100 + i, "hot text", "en", "a") for i in range(50)]
    df = documents(spark, rows)
    got = exact_dedup.drop_copies(df, counters=3)
    assert got.columns == df.columns
    want = Counter(k for k in brute(rows).elements() if k[3])
    assert Counter(r.doc_id for r in got.collect()) == Counter(k[0] for k in want.elements())


def test_empty_table(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).collect() == []
    assert exact_dedup.drop_copies(documents(spark, [])).collect() == []
