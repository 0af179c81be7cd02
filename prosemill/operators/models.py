"""Clustering, features and linear models on DataFrames, and the scorer interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.functions import text as X


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """df with ``cluster`` by k-means on an array column."""
    d = df.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(d)
    return model.transform(d).drop("__v")


def tfidf(df: DataFrame, text: str, out: str, most_features: int = 12000, least_documents: int = 3) -> tuple[DataFrame, list[str]]:
    """(df with L2-normed TF-IDF of words and word pairs, vocabulary).

    The vocabulary is counted over all documents; terms in fewer than
    least_documents are left out.
    """
    d = df.withColumn("__t", X.tokens(F.col(text)))
    d = NGram(n=2, inputCol="__t", outputCol="__g").transform(d).withColumn("__a", F.concat("__t", "__g"))
    counts = CountVectorizer(inputCol="__a", outputCol="__c", vocabSize=most_features, minDF=float(least_documents)).fit(d)
    d = counts.transform(d)
    d = IDF(inputCol="__c", outputCol="__i").fit(d).transform(d)
    return Normalizer(inputCol="__i", outputCol=out).transform(d).drop("__t", "__g", "__a", "__c", "__i"), counts.vocabulary


def linear_regression(df: DataFrame, features: str, label: str):
    """A ridge regression of label on a vector column."""
    return LinearRegression(featuresCol=features, labelCol=label, regParam=0.1, maxIter=30).fit(df)


def logistic_regression(df: DataFrame, vector: str, label: str):
    """(model, df with prediction) of a logistic regression on an array column."""
    d = df.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).withColumn("__y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="__v", labelCol="__y", regParam=0.01, maxIter=30).fit(d)
    return model, model.transform(d).drop("__v", "rawPrediction", "probability", "__y")


Scorer = Callable[[list[str]], list[float]]


def with_scores(df: DataFrame, text: str, out: str, load: Callable[[], Scorer]) -> DataFrame:
    """df with a model's score of each text.

    ``load`` runs once per Python worker and returns a function over a batch of
    texts; external models plug in here. Null texts get null.
    """
    names = df.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load()
        for b in batches:
            texts = b.column(text).to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None]
            values: list[float | None] = [None] * len(texts)
            for i, v in zip(some, scorer([texts[i] for i in some]) if some else []):
                values[i] = float(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.float64())], names=[*names, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return df.mapInArrow(score, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def heuristic_scorer() -> Scorer:
    """A deterministic stand-in for a detector: repetition and lack of variety, in [0, 1]. Not a trained model."""

    def score(texts: list[str]) -> list[float]:
        out = []
        for t in texts:
            ws = t.lower().split()
            pairs = list(zip(ws, ws[1:]))
            out.append(round(1 - 0.5 * (len(set(ws)) / len(ws) + len(set(pairs)) / max(1, len(pairs))), 6) if ws else 0.0)
        return out

    return score


def distinct_scored(df: DataFrame, text: str, out: str, load: Callable[[], Scorer]) -> DataFrame:
    """Like with_scores, but each distinct text is scored once and joined back."""
    some = df.select(text).filter(F.col(text).isNotNull()).distinct()
    return df.join(with_scores(some, text, out, load), text, "left")


Generator = Callable[[list[str]], list[str]]


def with_generations(df: DataFrame, prompt: str, out: str, load: Callable[[], Generator]) -> DataFrame:
    """df with a text generator's answer to each prompt; the generator plugs in as in with_scores."""
    from pyspark.sql.types import StringType, StructField, StructType

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = load()
        for b in batches:
            prompts = [p or "" for p in b.column(prompt).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(generate(prompts), pa.string())], names=[*names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def reuse_or_generate(df: DataFrame, prompt: str, logged: str, out: str, load: Callable[[], Generator]) -> DataFrame:
    """The logged text where there is one; else a generation. Rows that need none don't reach the generator."""
    have = df.filter(F.trim(F.coalesce(logged, F.lit(""))) != "").withColumn(out, F.col(logged))
    rest = df.filter(F.trim(F.coalesce(logged, F.lit(""))) == "")
    return have.unionByName(with_generations(rest, prompt, out, load))
