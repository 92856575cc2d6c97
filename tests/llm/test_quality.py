import math
import random
import re
from collections import Counter

import numpy as np
from tessera.llm import quality

from .support import awkward, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def clean(seed):
    rng = random.Random(seed)
    return "\n".join(prose(seed * 50 + k, rng.randint(8, 30)) for k in range(rng.randint(7, 12)))


def corpus():
    rows = awkward() + [(14, "x y z " * 30, "en", "a"), (15, "l\n \nl\nm\nl\n" + prose(3, 60), "en", "a"), (16, prose(4, 200) + " #$%", "en", "a")]
    rows += [(1000 + i, clean(i), "en" if i % 3 else "de", "a" if i % 2 else "b") for i in range(400)]
    junk = [(5000 + i, " ".join(w + "$%&#" for w in clean(7000 + i).split()), "en", "a") for i in range(12)]
    junk += [(5100 + i, "\n".join([prose(i, 7)] * 9 + [prose(i + k, 9) for k in range(9)]), "en", "b") for i in range(8)]
    long = [(5200 + i, " ".join(a + b + a + b for a, b in zip(clean(i).split(), clean(i + 50).split())), "de", "a") for i in range(5)]
    return rows, junk + long


def test_statistics_equal_brute_force(spark):
    rows = sum(corpus(), [])
    got = quality.judged(documents(spark, rows).repartition(3)).collect()
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    have = Counter((r.doc_id, *(r[c] for c in cols), r.base_failed) for r in got)
    want = Counter()
    for r in rows:
        b = brute(r[1])
        want[(r[0], *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert have == want
    assert all(not r.kept for r in got if r.base_failed)


def test_outliers_go_and_clean_documents_stay(spark):
    rows, junk = corpus()
    kept = {r.doc_id: r.kept for r in quality.judged(documents(spark, rows + junk).repartition(3)).collect()}
    assert [i for i in range(1000, 1400) if not kept[i]] == []
    assert [r[0] for r in junk if kept[r[0]]] == []


def test_estimate_is_robust(spark):
    """Close to the estimate of the clean part, though a fifth of the vectors is far away."""
    rng = np.random.default_rng(3)
    good = rng.multivariate_normal([1, 0, 2, 1], np.diag([0.3, 0.5, 0.8, 1.0]) ** 2, 2000)
    bad = rng.normal(9, 0.1, (500, 4))
    data = [("g", False, *(int(round(1000 * v)) for v in x)) for x in np.concatenate([good, bad])]
    df = spark.createDataFrame(data, "pool string, base_failed boolean, x0 long, x1 long, x2 long, x3 long")
    s = quality.Settings(floors=(0.01,) * 4)
    e = quality.estimates(df, s).first()
    assert max(abs(e[f"m{i}"] - m) for i, m in enumerate([1, 0, 2, 1])) < 0.1
    assert max(abs(math.log(e[f"l{i}{i}"] / v)) for i, v in enumerate([0.3, 0.5, 0.8, 1.0])) < 0.2


def test_reruns_agree_and_small_groups_are_pooled(spark):
    rows = [(i, clean(i), "en", f"s{i % 40}") for i in range(120)] + [(900, " ".join(w + "$%&#" for w in clean(1).split()), "en", "s1")]
    a, b = (sorted(map(tuple, quality.judged(documents(spark, rows).repartition(n)).collect())) for n in (1, 4))
    assert a == b and not a[-1][-1] and a[-1][-2] > 36
    few = quality.judged(documents(spark, rows[-3:])).collect()
    assert all(r.kept and r.distance2 is None for r in few)


def test_empty_table(spark):
    assert quality.judged(documents(spark, [])).collect() == []


def symbols(text, share, cells=False):
    """``text`` with so many symbols for a hundred word characters, in words or as cell marks."""
    words = text.split(" ")
    n = math.ceil(sum(map(len, text.split())) * share / (100 - share))
    for k in range(n):
        at = (k * 7919) % len(words)
        words[at] = words[at] + " |" if cells else words[at] + "#$%&"[k % 4]
    return " ".join(words)


def test_symbols_go_where_a_source_has_none(spark):
    rows = [(i, clean(i), "en", "plain") for i in range(300)]
    junk = [(5000 + 100 * share + i, symbols(clean(400 + i), share, cells), "en", "plain") for share in (6, 10, 15) for i, cells in enumerate((False, False, False, share == 6))]
    tables = [(7000 + i, symbols(clean(500 + i), 6 + i % 8, True), "en", "tables") for i in range(150)]
    mixed = [(8000 + i, symbols(clean(700 + i), 8 + i % 5, True) if i % 25 == 0 else clean(700 + i), "en", "some tables") for i in range(300)]
    kept = {r.doc_id: r.kept for r in quality.judged(documents(spark, rows + junk + tables + mixed).repartition(3)).collect()}
    assert [r[0] for r in junk if kept[r[0]]] == []
    assert [r[0] for r in rows + tables + mixed if not kept[r[0]]] == []
