"""A re-ranker that is trained on judged results: how much of a query stands in a text, and how together.

Features are worked out by an iterator UDF over Arrow batches, which loads the weights once for each
task; the weights, a number for each feature, come from a logistic regression over all judged
pairs. Null texts and queries without words have features of zero."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a run, by feature; then how early the first word stands, and how long the text is.
RUNS = (1, 2, 4)
_WORDS = re.compile(r"\w+")


def features(query: str, text: str) -> list[float]:
    """Shares of the query's runs of words that the text has, the place of the first, and the text's length."""
    asked, said = _WORDS.findall(query.lower()), _WORDS.findall(text.lower())
    out = []
    for n in RUNS:
        wanted = {tuple(asked[k : k + n]) for k in range(len(asked) - n + 1)}
        held = {tuple(said[k : k + n]) for k in range(len(said) - n + 1)} if wanted else set()
        out.append(len(wanted & held) / len(wanted) if wanted else 0.0)
    places = {w: k for k, w in reversed(list(enumerate(said)))}
    first = min((places[w] for w in asked if w in places), default=len(said))
    return [*out, 1.0 - first / len(said) if said else 0.0, math.log1p(len(said)) / 10]


def vectors(query: Column, text: Column) -> Column:
    """The features of pairs."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            yield pd.Series([features(q or "", t or "") for q, t in zip(queries, texts, strict=True)])

    return of(query, text)


class Reranker:
    """Weights of the features, and a last one for all."""

    def __init__(self, weights: list[float]):
        if len(weights) != len(RUNS) + 3:
            raise ValueError(f"a re-ranker has {len(RUNS) + 3} weights")
        self.weights = [float(w) for w in weights]

    @classmethod
    def trained(cls, pairs: DataFrame) -> Reranker:
        """Fitted to all judged pairs (query, text, label of 0 or 1)."""
        rows = pairs.select(array_to_vector(vectors(F.col("query"), F.col("text"))).alias("features"), F.col("label").cast("double").alias("label"))
        model = LogisticRegression(regParam=0.001, maxIter=50).fit(rows)
        return cls([*model.coefficients.toArray(), model.intercept])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.weights),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Reranker:
        return cls(json.loads(spark.read.text(path).first()[0]))

    def relevance(self, query: Column, text: Column) -> Column:
        """From 0 to 1, higher for texts that answer the query likelier."""
        weights = self.weights

        @F.pandas_udf("double")
        def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            own, bias = np.array(weights[:-1]), weights[-1]  # once a task
            for queries, texts in batches:
                x = np.array([features(q or "", t or "") for q, t in zip(queries, texts, strict=True)]).reshape(-1, len(own))
                yield pd.Series(1 / (1 + np.exp(-np.clip(x @ own + bias, -50, 50))))

        return of(query, text)

    def for_search(self, texts: DataFrame) -> Callable[[str, DataFrame], DataFrame]:
        """What ``search.search`` takes: (document_id, relevance) of found documents, by their texts (document_id, text)."""

        def score(query: str, found: DataFrame) -> DataFrame:
            read = found.select("document_id").join(texts.select("document_id", "text"), "document_id", "left")
            return read.select("document_id", self.relevance(F.lit(query), F.col("text")).alias("relevance"))

        return score
