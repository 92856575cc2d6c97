import random

import pytest
from pyspark.sql import functions as F
from tessera.llm import toxicity

from .support import awkward, documents, prose

BAD = ["zounds", "varlet", "knave", "churl"]


def corpus(n=900):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        w = prose(i, rng.randint(5, 120)).split()
        toxic, junk = rng.random() < 0.2, rng.random() < 0.3
        for word, on in ((BAD, toxic), (["spamword", "clickhere"], junk)):
            for _ in range(rng.randint(2, 4) if on else 0):
                w.insert(rng.randint(0, len(w)), rng.choice(word).upper() + ",")
        rows.append((i, " ".join(w), "en", "a"))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = documents(spark, rows)
    model = toxicity.fit(docs, labelled(spark, labels[:600] + labels[:50] + [(None, 1, 1), (3, None, None)]))
    assert {w.lower() for w in BAD} <= set(model.vocabulary) and len(model.models) == 2
    assert model.models[1].numFeatures == len(model.vocabulary) + 1  # the chain's earlier probability
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = [out[i].is_toxic == bool(t) for i, _, t in labels[600:]]
    assert sum(right) / len(right) > 0.97
    junk = [out[i].is_junk == (not q) for i, q, _ in labels[600:]]
    assert sum(junk) / len(junk) > 0.95


def test_sample_is_bounded(spark):
    rows, labels = corpus(200)
    s = toxicity.Settings(sample=40, least_docs=2, least_chi2=1.0)
    assert toxicity.fit(documents(spark, rows), labelled(spark, labels), s).models[0].summary.totalIterations >= 0


def test_awkward_documents(spark):
    rows, labels = corpus(300)
    model = toxicity.fit(documents(spark, rows), labelled(spark, labels), toxicity.Settings(least_chi2=3.0))
    extra = awkward() + [(77, "KNAVE! churl; varlet zounds knave", "en", "a"), (78, prose(5, 20_000) + " knave churl zounds varlet", "en", "a")]
    df = documents(spark, extra)
    out = toxicity.score(df, model)
    assert out.columns == df.columns + ["p_junk", "p_toxic", "is_junk", "is_toxic"]
    got = out.collect()
    assert len(got) == len(extra) and all(0 <= r.p_toxic <= 1 for r in got)
    assert {r.doc_id for r in got if r.is_toxic} == {77, 78}


@pytest.mark.parametrize("case", ["no labels", "no documents", "one class"])
def test_little_to_learn_from(spark, case):
    rows, labels = corpus(60)
    labels = [] if case == "no labels" else [(i, 1, 0) for i, _, _ in labels] if case == "one class" else labels
    docs = documents(spark, [] if case == "no documents" else rows)
    out = toxicity.score(docs, toxicity.fit(docs, labelled(spark, labels)))
    assert out.count() == (0 if case == "no documents" else 60)
    assert out.where(F.col("is_toxic") | F.col("p_toxic").isNull()).count() == 0
