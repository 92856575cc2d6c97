"""Corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result to the
shared folder as Parquet, and the next stage reads it. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from tessera.llm.common import stage, written

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic. Labels of documents that are gone aren't used."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("not is_toxic").select(*docs.columns)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near_copies(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, once for each pass over its source."""
    return mixing.mixed_texts(mixing.mix(docs, whole=True), docs.columns)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's ids, and the text that they decode to. Ids are stored in between: so a core has one Python worker at a time."""
    ids = written(bpe.encode(docs.select("doc_id", "lang", "source", "text"), BYTE_BPE, drop=("text",)), "ids")
    return bpe.decode(ids, BYTE_BPE).select("doc_id", "lang", "source", "ids", "decoded")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: Classifier, permutations and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = written(f(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
