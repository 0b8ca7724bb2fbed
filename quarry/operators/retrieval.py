"""Dense, sparse and hybrid retrieval, grouping by document, and re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.expressions import cosine

#: Candidates of a search: at least, at most, and for each document wanted.
LEAST, MOST, EACH = 100, 500, 20
RRF = 60


def dense_topk(chunks: DataFrame, query: list[float], k: int, ordinal: str = "ordinal") -> DataFrame:
    """The k chunks (column embedding) most like the query, ties in ordinal order."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    return chunks.withColumn("score", cosine(F.col("embedding"), vector)).drop("embedding").orderBy(F.desc("score"), ordinal).limit(k)


def words(text: Column) -> Column:
    return F.expr("regexp_extract_all(lower(coalesce(%s, '')), '[\\\\p{L}\\\\p{N}]+', 0)" % text) if isinstance(text, str) else F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def bm25_scores(tf: DataFrame, whole: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) from the lists (term, doc_id, tf, len) of a query's terms and the one row ``whole``
    (n, avgdl)."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    joined = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole))  # one row each term, one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return joined.groupBy("doc_id").agg(F.sum(part).alias("score"))


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of the documents with one of the terms, without an index (``PostingIndex``). Only the
    query's own terms are exploded; lengths and the number of documents come from one aggregate."""
    tokens = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    counted = tokens.select("doc_id", F.size("w").alias("len"), F.explode(F.filter("w", lambda x: x.isin(terms))).alias("term"))
    tf = counted.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    return bm25_scores(tf, tokens.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl")), k1, b)


def rrf(lists: list[DataFrame], key: str, limit: int, constant: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of lists (key, rank from 1)."""
    union = lists[0].select(key, "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select(key, "rank"))
    fused = union.groupBy(key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return fused.orderBy(F.desc("score"), key).limit(limit)


def grouped(matches: DataFrame, limit: int) -> DataFrame:
    """A row for each document: its best chunk, its score, and the other chunks found."""
    order = Window.partitionBy("document_id").orderBy(F.desc("score"), "ordinal")
    ranked = matches.withColumn("rn", F.row_number().over(order))
    related = F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.struct("rn", "ordinal", "score"))))
    out = ranked.groupBy("document_id").agg(F.max("score").alias("score"), F.min_by("ordinal", "rn").alias("ordinal"), related.alias("related"))
    return out.orderBy(F.desc("score"), "ordinal").limit(limit)


def levels(pool: int) -> list[int]:
    """The numbers of candidates that are tried for a pool of documents."""
    out = [min(MOST, max(LEAST, EACH * pool))]
    while out[-1] < MOST:
        out.append(min(MOST, 2 * out[-1]))
    return out


def grown(ranked: DataFrame, pool: int) -> DataFrame:
    """The candidates (column rank from 1) of the first level that holds ``pool`` documents or
    that the store cannot fill, else of the last."""
    found = ranked.filter(F.col("rank") <= MOST)
    each = [(level, F.size(F.collect_set(F.when(F.col("rank") <= level, F.col("document_id"))))) for level in levels(pool)]
    got = found.agg(F.count("*").alias("n"), *[n.alias(f"l{level}") for level, n in each]).first()
    for level, _ in each:
        if got[f"l{level}"] >= pool or got["n"] < level:
            return found.filter(F.col("rank") <= level)
    return found


def hybrid(chunks: DataFrame, dense: DataFrame, sparse: DataFrame, pool: int) -> DataFrame:
    """The chunks of two lists (ordinal, rank from 1) by reciprocal ranks, of the first level of
    candidates that holds ``pool`` documents, that the lists cannot fill, or that is the last.

    At each level both lists are as long as it. No more than ``MOST`` rows of a list reach the
    driver; the chunks are read once, by the ordinals found."""
    spark = chunks.sparkSession
    lists = [[tuple(r) for r in x.select("ordinal", "rank").filter(F.col("rank") <= MOST).limit(MOST).collect()] for x in (dense, sparse)]
    found = spark.createDataFrame(sorted({(o,) for x in lists for o, _ in x}), "ordinal long")
    held = chunks.drop("embedding").join(F.broadcast(found), "ordinal", "left_semi")
    rows = held.collect()
    document = {r["ordinal"]: r["document_id"] for r in rows}
    best: list[tuple[int, float]] = []
    for level in levels(pool):
        scores: dict[int, float] = {}
        for listed in lists:
            for ordinal, rank in listed:
                if rank <= level and ordinal in document:
                    scores[ordinal] = scores.get(ordinal, 0.0) + 1.0 / (RRF + rank)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:level]
        if len({document[o] for o, _ in best}) >= pool or len(best) < level:
            break
    scored = spark.createDataFrame(best, "ordinal long, score double")
    return spark.createDataFrame(rows, held.schema).join(F.broadcast(scored), "ordinal")


def rerank(results: DataFrame, relevance: Column, limit: int) -> DataFrame:
    """Results by another relevance; the retrieval score stays."""
    return results.withColumn("relevance", relevance).orderBy(F.desc("relevance"), F.desc("score"), "document_id").limit(limit)
