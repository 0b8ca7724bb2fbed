"""Stored inverted indexes, and BM25 over them.

``PostingIndex`` holds posting lists in ranges of (term, doc_id), so that a query reads only the row
groups whose range of terms holds one of its own, and a frequent term is spread over many files.

``BlockIndex`` is for the best few documents. Documents are dealt to shards by likeness and length; the postings of
a term in a shard are one block, with the greatest part of a score that any of them can have. A search
reads these bounds first, scores the shards whose terms promise most, and then of the others
only those that can still reach the k-th score: the blocks of the rest are never read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.retrieval import bm25_scores, words
from quarry.session import stored


class PostingIndex:
    """``postings`` (term, doc_id, tf, len) and ``whole`` (n, avgdl) below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, docs: DataFrame) -> PostingIndex:
        """Index documents (doc_id, text), a row for each id. Counts are added up before the shuffle: one
        row for each term of a document is moved, however often it occurs."""
        # dealt by document before they are cut: counting moves nothing, and texts are less than their words
        dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition("doc_id")
        tokens = dealt.select("doc_id", words(F.col("text")).alias("w"))
        counted = tokens.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
        # stored, for ranges are drawn from a sample: texts are cut into words once
        counted = stored(counted, "counted")
        counted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{self.path}/postings")
        n, words_ = docs.count(), counted.agg(F.sum("tf")).first()[0]  # the lengths of all documents are the numbers of their words
        self.spark.createDataFrame([(n, (words_ or 0) / n if n else None)], "n long, avgdl double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/whole")
        return self

    def search(self, terms: list[str]) -> DataFrame:
        """(doc_id, score) of the documents with one of the terms, read from their lists alone."""
        lists = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("term").isin(terms))
        return bm25_scores(lists, self.spark.read.parquet(f"{self.path}/whole"))


#: Documents of a shard, and shards that are scored first.
SHARD, FIRST = 1024, 8
K1, B = 1.2, 0.75


def _commonest(found: Column) -> Column:
    """The commonest word of a list; null of an empty one."""
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("best"), F.lit(0).alias("most"))

    def step(seen: Column, word: Column) -> Column:
        n = F.when(seen["word"].eqNullSafe(word), seen["n"] + 1).otherwise(1)
        more = n > seen["most"]
        return F.struct(word.alias("word"), n.alias("n"), F.when(more, word).otherwise(seen["best"]).alias("best"), F.when(more, n).otherwise(seen["most"]).alias("most"))

    return F.aggregate(F.array_sort(found), start, step, lambda seen: seen["best"])


class BlockIndex:
    """``blocks`` (term, shard, n, upper, postings) and ``whole`` (n, avgdl, shards) below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, docs: DataFrame, shard: int = SHARD) -> BlockIndex:
        """Index documents (doc_id, text), a row for each id. Documents share a shard that have their commonest
        word in common, as those of one language do, and then their length: so bounds of shards lie
        close to the scores in them."""
        tokens = stored(docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w")).withColumn("len", F.size("w")), "tokens")
        whole = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")).first()
        counted = self._counted(tokens, shard)
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(whole["avgdl"] or 1.0)))
        blocks = counted.groupBy("term", "shard").agg(F.count("*").alias("n"), F.max(part).alias("upper"), F.collect_list(F.struct("doc_id", "tf", "len")).alias("postings"))
        blocks.sortWithinPartitions("term", "shard").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{self.path}/blocks")
        self.spark.createDataFrame([(whole["n"], whole["avgdl"])], "n long, avgdl double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/whole")
        return self

    def _counted(self, tokens: DataFrame, shard: int) -> DataFrame:
        """A row for each term of a document, with its shard."""
        # the place within a range is the lower part of an id that grows with the rows
        ordered = tokens.withColumn("lead", _commonest(F.col("w"))).repartitionByRange("lead", "len", "doc_id").sortWithinPartitions("lead", "len", "doc_id").withColumn("at", F.monotonically_increasing_id())
        dealt = ordered.withColumn("shard", F.shiftleft(F.shiftright("at", 33), 33) + F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / shard))
        # the keys of the ranges are among those of the groups: counting moves nothing
        return dealt.select("lead", "len", "doc_id", "shard", F.explode("w").alias("term")).groupBy("lead", "len", "doc_id", "shard", "term").agg(F.count("*").alias("tf"))

    def _scored(self, blocks: DataFrame, idf: Column, avgdl: float) -> DataFrame:
        rows = blocks.select("term", F.explode("postings").alias("p")).select("term", "p.*")
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avgdl)))
        return rows.groupBy("doc_id").agg(F.sum(part).alias("score"))

    def topk(self, terms: list[str], k: int, first: int = FIRST) -> tuple[DataFrame, dict[str, int]]:
        """(doc_id, score) of the k best documents, as of all postings, ties by doc_id; and how many blocks
        there were and were read."""
        terms = sorted(set(terms))
        empty = self.spark.createDataFrame([], "doc_id long, score double")
        whole = self.spark.read.parquet(f"{self.path}/whole").first()
        blocks = self.spark.read.parquet(f"{self.path}/blocks").filter(F.col("term").isin(terms))
        df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # the query's terms
        if not df or k < 1:
            return empty, {"blocks": 0, "read": 0}
        weights = {t: float(np.log1p((whole["n"] - d + 0.5) / (d + 0.5))) for t, d in df.items()}
        idf = F.create_map(*[F.lit(x) for p in weights.items() for x in p])[F.col("term")]
        bounds = stored(blocks.groupBy("shard").agg(F.sum(idf * F.col("upper")).alias("bound"), F.count("*").alias("blocks")), "bounds")
        ahead = bounds.orderBy(F.desc("bound"), "shard").limit(first).collect()
        chosen = [r["shard"] for r in ahead]
        found = stored(self._scored(blocks.filter(F.col("shard").isin(chosen)), idf, whole["avgdl"]).orderBy(F.desc("score"), "doc_id").limit(k), "ahead")
        reached = found.agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
        least = reached["score"] * (1 - 1e-12) if reached["n"] == k else -1.0
        rest = bounds.filter(~F.col("shard").isin(chosen) & (F.col("bound") >= least))
        counts = bounds.agg(F.sum("blocks").alias("all"), F.sum(F.when(F.col("shard").isin(chosen) | (F.col("bound") >= least), F.col("blocks"))).alias("read")).first()
        more = self._scored(blocks.join(rest.select("shard"), "shard", "left_semi"), idf, whole["avgdl"])
        return found.unionByName(more).orderBy(F.desc("score"), "doc_id").limit(k), {"blocks": counts["all"], "read": counts["read"]}
