from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F
from tessera.llm.common import written

from tests.conftest import SF_SMALL

from .test_exact_dedup import brute as exact
from .test_near_dedup import brute as near


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept, tables = docs, []
    for name, stage in P.STAGES:
        kept = written(stage(spark, kept, SF_SMALL), "test-stage")
        tables.append(kept)
    for t in tables[:-1]:
        assert t.schema.names == docs.schema.names
    rows = [[tuple(r) for r in t.select("doc_id", "text", "lang", "source").collect()] for t in [docs, *tables[:4]]]
    ids = [Counter(r[0] for r in x) for x in rows]
    assert ids[1] <= ids[0] and ids[1] != ids[0]
    toxic = {r[0] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("toxic = 1").collect()}  # 11 are few to learn from
    assert sum(i not in ids[1] for i in toxic) >= 0.5 * len(toxic)
    assert not {r[0] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("toxic = 0").collect()} & (set(ids[0]) - set(ids[1]))
    assert ids[2] == Counter(k[0] for k in exact(rows[1]).elements() if k[3])
    assert ids[3] == Counter(k[0] for k in near(rows[2]).elements() if k[3])
    words = [sum(len(r[1].encode().split()) for r in x) for x in rows[3:]]
    assert abs(words[1] - 1.5 * words[0]) <= 25  # a word for each source
    done = tables[4].collect()
    assert Counter(r.decoded for r in done) == Counter(r[1] for r in rows[4])


def test_run_returns_the_last_stage(spark):
    out = P.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "lang", "source", "ids", "decoded"] and out.where(F.size("ids") == 0).count() == 0


def test_encoding_and_decoding_have_workers_one_after_the_other(spark):
    """Python workers stand beside the executor's heap: a task of the last stage has one."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(20)
    plan = P.encode(spark, docs, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
