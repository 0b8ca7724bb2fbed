"""Queries built with the DataFrame operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import expressions as X
from quarry.operators import chunking, retrieval
from quarry.operators.search import MOST_POOL
from quarry.plans import chunk_sql
from quarry.plans.fixtures import CATEGORY, FILES, SUPPORTED
from quarry.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Words of the sparse queries.
TERMS = ["the", "les", "und"]


def query(name: str, sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        ORACLES[name] = sql
        return run

    return register


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings")
    return chunks.select(F.concat(F.lit("d"), F.floor(F.col("vec_id") / 5).cast("string")).alias("document_id"), F.col("vec_id").alias("ordinal"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


SCORED = """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
scored AS (SELECT 'd' || CAST(CAST(floor(vec_id / 5) AS BIGINT) AS STRING) AS document_id, vec_id AS ordinal,
  list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS score FROM embeddings, q),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, ordinal) AS rank FROM scored)"""


@query("dense_topk", SCORED + " SELECT document_id, ordinal, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.dense_topk(chunk_vectors(spark, sf_dir), query_vector(spark, sf_dir), 10)
    return top.select("document_id", "ordinal", F.round("score", 6).alias("score"))


GROUPED = """, g AS (SELECT document_id, max(score) AS score, arg_min(ordinal, rank) AS ordinal, count(*) - 1 AS related FROM {of} GROUP BY document_id)
SELECT document_id, round(score, 6) AS score, ordinal, CAST(related AS INT) AS related FROM g ORDER BY g.score DESC, ordinal LIMIT 5"""


@query("dense_grouped", SCORED + ", top AS (SELECT * FROM ranked WHERE rank <= 100)" + GROUPED.replace("{of}", "top"))
def dense_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = retrieval.dense_topk(chunk_vectors(spark, sf_dir), query_vector(spark, sf_dir), 100)
    return retrieval.grouped(matches, 5).select("document_id", F.round("score", 6).alias("score"), "ordinal", F.size("related").alias("related"))


@query("candidate_growth", SCORED + """, l AS (SELECT unnest([500]) AS level),
n AS (SELECT level, count(DISTINCT document_id) AS docs, count(*) AS found FROM l JOIN ranked ON rank <= level GROUP BY level),
c AS (SELECT coalesce(min(level) FILTER (WHERE docs >= 50 OR found < level), 500) AS level FROM n)
SELECT document_id, ordinal, rank FROM ranked, c WHERE rank <= level""")
def candidate_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.dense_topk(chunk_vectors(spark, sf_dir), query_vector(spark, sf_dir), retrieval.MOST)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ordinal")).cast("long"))
    return retrieval.grown(ranked, 50).select("document_id", "ordinal", "rank")


@query("l2_normalize", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS total FROM embeddings""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(X.normalised(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 6).alias("total"))


BM25 = """WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
whole AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS (SELECT doc_id, len(w) AS len, t AS term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM tok) x WHERE t IN ('the', 'les', 'und') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM tf JOIN df USING (term), whole GROUP BY doc_id)"""


@query("bm25_topk", BM25 + " SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.bm25(table(spark, sf_dir, "documents"), TERMS)
    return scored.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query("hybrid_rrf", BM25 + """, a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm),
b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
u AS (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM u GROUP BY doc_id ORDER BY sum(1.0 / (60 + rank)) DESC, doc_id LIMIT 20""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def top(df: DataFrame, by: str) -> DataFrame:
        best = df.orderBy(F.desc(by), "doc_id").limit(50)
        return best.select("doc_id", F.row_number().over(Window.orderBy(F.desc(by), "doc_id")).alias("rank"))

    sparse = retrieval.bm25(docs, TERMS).withColumn("score", F.round("score", 6))
    fused = retrieval.rrf([top(sparse, "score"), top(docs.select("doc_id", "n_chars"), "n_chars")], "doc_id", 20)
    return fused.select("doc_id", F.round("score", 6).alias("score"))


FNV = "list_reduce(list_transform(string_split({x}, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261)"


@query("fnv_hash", f"SELECT DISTINCT source, {FNV.replace('{x}', 'source')} AS hash FROM documents")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", X.fnv1a(F.col("source")).alias("hash"))


@query("stratified_sample", f"""WITH files AS ({FILES.replace('{documents}', 'documents')}), t AS (SELECT id, {CATEGORY} AS category FROM files WHERE {SUPPORTED}),
n AS (SELECT category, count(*) AS size FROM t GROUP BY category), k AS (SELECT *, sum(size) OVER () AS total, count(*) OVER () AS strata FROM n),
q AS (SELECT *, (100 - strata) * (size - 1.0) / (total - strata) AS share FROM k),
r AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, size DESC, category) AS place, sum(floor(share)) OVER () AS given FROM q),
a AS (SELECT category, 1 + floor(share) + CASE WHEN place <= 100 - strata - given THEN 1 ELSE 0 END AS take FROM r),
o AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY {FNV.replace('{x}', 'id')}, id) AS place FROM t)
SELECT id, o.category FROM o JOIN a USING (category) WHERE place <= take""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.sampling import stratified

    files = spark.sql(f"WITH files AS ({FILES}) SELECT id, {CATEGORY} AS category FROM files WHERE {SUPPORTED}", documents=table(spark, sf_dir, "documents"))
    return stratified(files, 100)


@query("chunk_documents", chunk_sql.chunks("SELECT doc_id AS key, 0 AS part, text, 900 AS size, 100 AS overlap FROM documents") + " SELECT key AS doc_id, n AS chunk_index, key || ':' || n AS chunk_id, content FROM pieces")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents"))


@query("query_normalize", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM conversations")
def query_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.collapsed(F.col("text")).alias("q"))


@query("preview", "WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM conversations) SELECT conv_id, turn, CASE WHEN length(q) > 40 THEN left(q, 40) || '…' ELSE q END AS preview FROM c")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.preview(F.col("text"), 40).alias("preview"))


@query("mention_strip", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM conversations")
def mention_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<@U1> "), F.col("text"), F.lit(" <@U1|bot>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.mention_query(text, "U1").alias("q"))


@query("token_features", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n_words, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS n_distinct FROM documents")
def token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = retrieval.words(F.coalesce(F.col("text"), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query("rerank_overlap", """WITH w AS (SELECT doc_id, n_chars, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents),
pool AS (SELECT * FROM w ORDER BY n_chars DESC, doc_id LIMIT 50)
SELECT 'd' || CAST(doc_id AS STRING) AS document_id, CAST(len(list_intersect(w, ['the', 'les', 'und'])) AS INT) AS relevance FROM pool ORDER BY relevance DESC, n_chars DESC, document_id LIMIT 10""")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(MOST_POOL)
    pool = best.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.col("n_chars").alias("score"), "text")
    overlap = F.size(F.array_intersect(retrieval.words(F.coalesce(F.col("text"), F.lit(""))), F.array(*map(F.lit, TERMS))))
    return retrieval.rerank(pool, overlap, 10).select("document_id", "relevance")
