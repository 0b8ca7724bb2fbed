"""A training-data pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` stores each stage's rows in the shared folder for the next.

Null texts have no letter and go at once. Rows without an id are kept by every stage that does not
find fault with their text; repeated rows are near duplicates of one another, as far as their ids
differ; an empty table gives an empty result; columns besides those of documents are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, jaccard, language, lines, mixing
from quarry.llm.common import spill, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on; texts without a letter, or that share no
    n-gram with any known language, go."""
    return language.keep_identified(docs, language.learn(docs))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one are cut out; documents left without a line go."""
    return lines.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of linked documents stays."""
    return jaccard.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mixture of sources."""
    return mixing.schedule(docs, mixing.target_weights())


STAGES = [
    ("language_id", identified),
    ("line_dedup", lines_once),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", without_benchmark),
    ("source_mixing", mixed),
]
#: Profiles, rarity orders and tilings are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
