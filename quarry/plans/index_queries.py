"""Queries over a posting index, of hybrid search, of folder trees and of reports, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import listing, reports, retrieval
from quarry.operators.postings import PostingIndex
from quarry.plans import frame_queries
from quarry.plans.operator_queries import DUCK, analysed
from quarry.session import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        ORACLES[name] = sql
        return run

    return register


@query("posting_search", frame_queries.BM25 + " SELECT doc_id, round(score, 6) AS score FROM bm")
def posting_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = PostingIndex(spark, scratch(spark, "postings")).build(table(spark, sf_dir, "documents"))
    return index.search(frame_queries.TERMS).select("doc_id", F.round("score", 6).alias("score"))


#: One chunk in forty is a document of its own, the others belong to one: few documents among many chunks.
UNEVEN = "CASE WHEN vec_id % 40 = 0 THEN 'd' || CAST(vec_id AS STRING) ELSE 'common' END"
POOL = 7
DENSE = frame_queries.SCORED.replace("'d' || CAST(CAST(floor(vec_id / 5) AS BIGINT) AS STRING)", UNEVEN)
LEVELS = ", l AS (SELECT unnest([140, 280, 500]) AS level)"


def uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.expr(UNEVEN).alias("document_id"), F.col("vec_id").alias("ordinal"), "embedding")


def best(scored: DataFrame, key: str) -> DataFrame:
    top = scored.orderBy(F.desc("score"), key).limit(retrieval.MOST)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


@query("candidate_growth_steps", DENSE + LEVELS + f""",
n AS (SELECT level, count(DISTINCT document_id) AS docs, count(*) AS found FROM l JOIN ranked ON rank <= level GROUP BY level),
c AS (SELECT coalesce(min(level) FILTER (WHERE docs >= {POOL} OR found < level), 500) AS level FROM n)
SELECT document_id, ordinal, rank FROM ranked, c WHERE rank <= level""")
def candidate_growth_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.dense_topk(uneven(spark, sf_dir), frame_queries.query_vector(spark, sf_dir), retrieval.MOST)
    return retrieval.grown(best(top, "ordinal"), POOL).select("document_id", "ordinal", "rank")


@query("hybrid_search", frame_queries.BM25 + ", " + DENSE.removeprefix("WITH ") + LEVELS + f""",
held AS (SELECT document_id, ordinal FROM ranked),
sp AS (SELECT doc_id AS ordinal, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm WHERE doc_id IN (SELECT ordinal FROM held)),
u AS (SELECT level, ordinal, rank FROM l JOIN sp ON rank <= level UNION ALL SELECT level, ordinal, rank FROM l JOIN ranked ON rank <= level),
s AS (SELECT level, ordinal, sum(1.0E0 / (60 + rank)) AS score FROM u GROUP BY level, ordinal),
t AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, ordinal) AS place FROM s),
k AS (SELECT t.*, held.document_id FROM t JOIN held USING (ordinal) WHERE place <= level),
n AS (SELECT level, count(DISTINCT document_id) AS docs, count(*) AS found FROM k GROUP BY level),
c AS (SELECT coalesce(min(level) FILTER (WHERE docs >= {POOL} OR found < level), 500) AS level FROM n)
SELECT document_id, ordinal, round(score, 6) AS score FROM k JOIN c USING (level)""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = uneven(spark, sf_dir)
    dense = best(retrieval.dense_topk(chunks, frame_queries.query_vector(spark, sf_dir), retrieval.MOST), "ordinal")
    index = PostingIndex(spark, scratch(spark, "postings")).build(table(spark, sf_dir, "documents"))
    found = index.search(frame_queries.TERMS).select(F.col("doc_id").alias("ordinal"), F.round("score", 6).alias("score"))
    sparse = best(found.join(chunks.select("ordinal"), "ordinal", "left_semi"), "ordinal")
    return retrieval.hybrid(chunks, dense, sparse, POOL).select("document_id", "ordinal", F.round("score", 6).alias("score"))


#: Customers as files in nations, those in regions below the root; one region hangs loose, and one nation holds the root.
EDGES = """SELECT 'n' || CAST(n_nationkey AS STRING) AS id, 'r' || CAST(n_regionkey AS STRING) AS parent, true AS is_folder FROM {nation}
UNION ALL SELECT 'r' || CAST(r_regionkey AS STRING), 'root', true FROM {region} WHERE r_regionkey <> 4
UNION ALL SELECT 'root', 'n0', true UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING), false FROM {customer}"""


@query("folder_walk", "WITH RECURSIVE edges AS (" + EDGES.replace("{", "").replace("}", "") + """),
walk AS (SELECT 'root' AS id UNION SELECT e.id FROM walk w JOIN edges e ON e.parent = w.id WHERE e.is_folder)
SELECT id, parent FROM edges WHERE NOT is_folder AND parent IN (SELECT id FROM walk)""")
def folder_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.sql(EDGES, **{t: table(spark, sf_dir, t) for t in ("nation", "region", "customer")})
    return listing.listed(edges, "root").select("id", "parent")


def _duck_cell(value: str) -> str:
    text = f"coalesce(CAST({value} AS VARCHAR), '')"
    return f"CASE WHEN regexp_matches({text}, '[\",\\n\\r]') THEN '\"' || replace({text}, '\"', '\"\"') || '\"' ELSE {text} END"


REPORTED = {"drive_file_id": "id", "name": "name || ',\"' || category", "mime_type": "mime", "category": "category", "status": "status", "duplicate_of_drive_file_id": "duplicate_of", "chunk_count": "chunk_count", "page_count": "page_count"}


@query("report_lines", DUCK.replace("SELECT t.id, t.category,", "SELECT t.id, t.name, t.mime, t.category,") + " SELECT id, " + " || ',' || ".join(_duck_cell(REPORTED[c]) if c in REPORTED else "''" for c in reports.CELLS) + " AS line FROM g")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = analysed(spark, sf_dir)
    cells = files.select("id", *[F.expr(v).alias(c) for c, v in REPORTED.items()])
    return cells.select("id", reports.csv_line(cells).alias("line"))
