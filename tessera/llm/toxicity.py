"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other: each is a logistic regression on word features and on the
probabilities of the categories before it. For training, those probabilities come from models that did not
see the document (out-of-fold predictions); for scoring, from the models fitted on the whole sample.

Features say whether a document has a word, for the words that tell most about the categories (by chi-squared
over the sample's documents). Only the fit uses a sample, of at most ``sample`` labelled documents, chosen by
hash; every document is scored on its whole text.

Defined results: a null or empty text has no words and gets the models' prior; label rows with a null id or
null label are not used, of repeated label rows the largest value counts; a repeated document is scored each
time; without labelled documents all probabilities are 0 and nothing is rejected; an empty table gives an
empty result. Extra columns pass through, but for columns named like the output.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, written


@dataclass(frozen=True)
class Category:
    """A document is in the category if the label ``column`` has ``value``."""

    name: str
    column: str
    value: int = 1


#: The labels at hand, in chain order: junk tells something about toxicity's absence, so it comes first.
CHAIN = (Category("junk", "quality", 0), Category("toxic", "toxic", 1))


@dataclass(frozen=True)
class Settings:
    """sample: most labelled documents for the fit. words: most words for a category. least_docs, least_chi2:
    what a word needs. folds: parts for out-of-fold predictions. threshold: probability from which a category holds."""

    chain: tuple[Category, ...] = CHAIN
    sample: int = 20_000
    words: int = 1_000
    least_docs: int = 5
    least_chi2: float = 15.0
    folds: int = 3
    reg: float = 3e-5
    steps: int = 40
    threshold: float = 0.5


@dataclass
class Model:
    settings: Settings
    vocabulary: list[str] = field(default_factory=list)
    models: list[LogisticRegressionModel] = field(default_factory=list)


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def _inputs(df: DataFrame, so_far: int) -> DataFrame:
    """Column ``x``: the word features and the probabilities p0 .. of the categories so far."""
    return VectorAssembler(inputCols=["found", *[f"p{i}" for i in range(so_far)]], outputCol="x").transform(df)


def _scored(model: LogisticRegressionModel, df: DataFrame, at: int) -> DataFrame:
    """Adds ``p{at}``."""
    out = model.transform(_inputs(df, at))
    return out.withColumn(f"p{at}", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def _lr(s: Settings, at: int) -> LogisticRegression:
    return LogisticRegression(featuresCol="x", labelCol=f"y{at}", regParam=s.reg, maxIter=s.steps, standardization=False)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    got = labels.where(F.col(id_col).isNotNull() & F.expr(" and ".join(f"`{c.column}` is not null" for c in s.chain)))
    ys = [F.max((F.col(c.column) == c.value).cast("double")).alias(f"y{i}") for i, c in enumerate(s.chain)]
    chosen = got.groupBy(F.col(id_col).alias("id")).agg(*ys).orderBy(F.xxhash64("id"), "id").limit(s.sample)
    chosen = written(chosen, "labels")  # at most s.sample rows of numbers
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id")
    own = own.groupBy("id", *[f"y{i}" for i in range(len(s.chain))]).agg(F.min("t").alias("t"))
    own = written(own.select("id", *[f"y{i}" for i in range(len(s.chain))], F.array_distinct(_words(F.col("t"))).alias("words")), "sample")

    sums = own.agg(F.count("*"), *[F.coalesce(F.sum(f"y{i}"), F.lit(0.0)) for i in range(len(s.chain))]).first()
    n = sums[0]
    if not n:
        return Model(s)
    ys = [F.sum(f"y{i}").alias(f"y{i}") for i in range(len(s.chain))]
    counts = own.select(F.explode("words").alias("word"), *[f"y{i}" for i in range(len(s.chain))]).where("word != ''")
    counts = counts.groupBy("word").agg(F.count("*").alias("docs"), *ys).where(F.col("docs") >= s.least_docs)
    counts = written(counts, "words")
    vocabulary: set[str] = set()
    for i in range(len(s.chain)):
        positive = sums[1 + i]
        a, docs_ = F.col(f"y{i}"), F.col("docs")
        gap = a * (n - positive - (docs_ - a)) - (docs_ - a) * (positive - a)
        chi2 = F.try_divide(n * gap * gap, docs_ * (n - docs_) * F.lit(positive) * F.lit(n - positive))  # null: tells nothing
        best = counts.withColumn("chi2", chi2).where(F.col("chi2") >= s.least_chi2).orderBy(F.desc("chi2"), "word").limit(s.words)
        vocabulary |= {r[0] for r in best.select("word").collect()}  # at most s.words for a category
    if not vocabulary:  # the vectorizer needs a word; no text has one with a space
        vocabulary = {" "}
    model = Model(s, sorted(vocabulary))

    train = _found(model, own).select("id", *[f"y{i}" for i in range(len(s.chain))], "found", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(s.folds)).alias("fold"))
    train = written(train.coalesce(4), "train")
    for i in range(len(s.chain)):
        model.models.append(_lr(s, i).fit(_inputs(train, i)))
        if i + 1 < len(s.chain):
            parts = []
            for k in range(s.folds):
                rest = _inputs(train.where(F.col("fold") != k), i)
                part = _lr(s, i).fit(rest) if not rest.isEmpty() else model.models[i]
                parts.append(_scored(part, train.where(F.col("fold") == k), i))
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            train = written(out, "folds")
    return model


def _found(model: Model, df: DataFrame) -> DataFrame:
    """Column ``found``: which of the vocabulary's words are among ``words``."""
    return CountVectorizerModel.from_vocabulary(model.vocabulary, inputCol="words", outputCol="found", minTF=1.0).setBinary(True).transform(df)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` and ``is_<category>`` for each category of the chain."""
    s = model.settings
    new = [f"p_{c.name}" for c in s.chain] + [f"is_{c.name}" for c in s.chain]
    columns = [c for c in docs.columns if c not in new]
    df = packed(docs.select(*[F.col(f"`{c}`") for c in columns]), words=_words(F.col(f"`{text_col}`")))
    if model.models:
        df = _found(model, df).drop("words")
        for i, m in enumerate(model.models):
            df = _scored(m, df, i)
    else:
        df = df.withColumns({f"p{i}": F.lit(0.0) for i in range(len(s.chain))})
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns], *[F.col(f"p{i}").alias(f"p_{c.name}") for i, c in enumerate(s.chain)],
                     *[(F.col(f"p{i}") >= s.threshold).alias(f"is_{c.name}") for i, c in enumerate(s.chain)])
