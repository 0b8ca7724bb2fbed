"""Queries on extraction, chunks, vectors of text, stored records and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import expressions as X
from quarry.functions.text import tidy, xml_decoded
from quarry.operators import chunking, embedding, evaluation
from quarry.operators.reranking import Reranker
from quarry.plans import chunk_sql
from quarry.plans.fixtures import FILES, PDF, PPTX, SLIDES
from quarry.session import stored, table
from quarry.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


# -- extraction ---------------------------------------------------------------------------
BLOCKS = "(?s)<(?:h1|p)(?:\\s[^>]*)?>.*?</(?:h1|p)>"


@query("heading_sections", f"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '{BLOCKS}')) AS block, generate_subscripts(regexp_extract_all(html, '{BLOCKS}'), 1) AS pos FROM pages),
t AS (SELECT page_id, pos, block LIKE '<h1%' AS heading, trim(regexp_replace(regexp_replace(block, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM b),
f AS (SELECT page_id, pos, text, heading, last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS title FROM t WHERE text <> '')
SELECT page_id, CAST(pos AS INT) AS pos, title, text FROM f WHERE NOT heading""")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each page with the heading above them. A page is one window group."""
    blocks = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(BLOCKS), F.lit(0))).alias("at", "block"))
    text = X.collapsed(F.regexp_replace("block", "<[^>]*>", ""))
    typed = blocks.select("page_id", (F.col("at") + 1).alias("pos"), F.col("block").startswith("<h1").alias("heading"), text.alias("text")).filter("text <> ''")
    above = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return typed.withColumn("title", F.last(F.when(F.col("heading"), F.col("text")), ignorenulls=True).over(above)).filter("NOT heading").select("page_id", "pos", "title", "text")


@query("slides_json", """SELECT conv_id, 1 AS slide, arg_min(trim(text), turn) FILTER (WHERE role = 'system' AND trim(text) <> '') AS title,
string_agg(trim(text), chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> '') AS text FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE trim(text) <> '') > 0""")
def slides_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a presentation of one slide, its turns as shapes, read back."""
    shape = F.struct(F.struct(F.struct(F.when(F.col("role") == "system", "TITLE").otherwise("BODY").alias("type")).alias("placeholder"), F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("textRun"))).alias("textElements")).alias("text")).alias("shape"))
    folded = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", shape.alias("e")))).alias("es"))
    deck = folded.select("conv_id", F.to_json(F.struct(F.array(F.struct(F.col("es.e").alias("pageElements"))).alias("slides"))).alias("json"))
    return files.slides_json(deck).select("conv_id", "slide", "title", "text")


PARAGRAPHS = "(?s)<p(?:\\s[^>]*)?>(.*?)</p>"


@query("xml_decode", f"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '{PARAGRAPHS}', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '{PARAGRAPHS}', 1), 1) - 1 AS pos FROM pages)
SELECT page_id, CAST(pos AS INT) AS pos, replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&') AS text FROM b""")
def xml_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the pages with their references decoded. The SQL twin knows the named ones,
    which are all that the pages hold; numeric ones are held against a plain loop in the tests."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(PARAGRAPHS), F.lit(1))).alias("pos", "raw"))
    return found.select("page_id", "pos", xml_decoded("raw").alias("text"))


@query("slide_text", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(160) || chr(12288)) AS text FROM documents")
def slide_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tidy(F.col("text")).alias("text"))


# -- chunks -------------------------------------------------------------------------------
SECTIONS_SQL = f"""SELECT id AS key, p AS part, parts[p] AS text, CASE WHEN mime IN ('{PPTX}', '{SLIDES}') THEN 1500 ELSE 900 END AS size, CASE WHEN mime = '{PDF}' THEN 120 ELSE 100 END AS overlap
FROM (SELECT id, mime, parts, unnest(range(1, len(parts) + 1)) AS p FROM (SELECT id, mime, string_split(coalesce(text, ''), chr(10) || chr(10)) AS parts FROM ({FILES.replace('{documents}', 'documents')}) f) x) y"""


@query("chunk_by_format", chunk_sql.chunks(SECTIONS_SQL) + f""" SELECT key AS document_id, n AS chunk_index, key || ':' || n AS chunk_id, content, CAST(part AS INT) AS page, CAST(NULL AS INT) AS slide, base AS section_title
FROM pieces JOIN ({FILES.replace('{documents}', 'documents')}) f ON f.id = key""")
def chunk_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file whose paragraphs are sections."""
    listed = spark.sql(FILES, documents=table(spark, sf_dir, "documents"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n\n")
    sections = F.transform(lines, lambda t, i: F.struct(t.alias("text"), (i + 1).cast("int").alias("page"), F.lit(None).cast("int").alias("slide"), F.col("base").alias("title")))
    return chunking.chunk_sections(listed.select(F.col("id").alias("document_id"), "mime", sections.alias("sections")))


@query("chunk_payload_bytes", """WITH p AS (SELECT conv_id, length(text) AS chars, strlen(text) AS size, strlen(CAST(to_json({'chunkId': conv_id || ':' || turn, 'documentId': CAST(conv_id AS STRING), 'chunkIndex': turn, 'content': text}) AS STRING)) AS whole FROM conversations)
SELECT conv_id, count(*) AS chunks, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(size) AS BIGINT) AS text_bytes, CAST(sum(greatest(0, whole - size)) AS BIGINT) AS metadata_bytes FROM p GROUP BY conv_id""")
def chunk_payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks: what their texts and what the rest of their payloads take."""
    payload = F.to_json(F.struct(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunkId"), F.col("conv_id").cast("string").alias("documentId"), F.col("turn").alias("chunkIndex"), F.col("text").alias("content")))
    sized = table(spark, sf_dir, "conversations").select("conv_id", F.length("text").alias("chars"), F.octet_length("text").alias("size"), F.octet_length(payload).alias("whole"))
    return sized.groupBy("conv_id").agg(F.count("*").alias("chunks"), F.sum("chars").alias("chars"), F.sum("size").alias("text_bytes"), F.sum(F.greatest(F.lit(0), F.col("whole") - F.col("size"))).alias("metadata_bytes"))


# -- vectors of text ----------------------------------------------------------------------
def fnv(text: str) -> str:
    return f"list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261)"


@query("hash_embedding", f"""WITH t AS (SELECT p_partkey, lower(trim(p_name)) AS s, regexp_extract_all(lower(p_name), '[\\p{{L}}\\p{{N}}]+') AS w FROM part),
f AS (SELECT p_partkey, 'word:' || unnest(w) AS f, 2.0E0 AS weight FROM t
  UNION ALL SELECT p_partkey, unnest(list_transform(range(1, len(w)), lambda i: 'pair:' || w[i] || '_' || w[i + 1])), 1.5E0 FROM t
  UNION ALL SELECT p_partkey, unnest(list_transform(range(1, length(s)), lambda i: 'char-2:' || substr(s, i, 2))), 0.55E0 FROM t
  UNION ALL SELECT p_partkey, unnest(list_transform(range(1, length(s) - 1), lambda i: 'char-3:' || substr(s, i, 3))), 0.35E0 FROM t),
c AS (SELECT p_partkey, f, weight, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT *, {fnv('f')} AS own, {fnv("f || ':sign'")} AS sign FROM c),
v AS (SELECT p_partkey, own % 384 AS bucket, sum(weight * (1 + ln(n)) * CASE WHEN sign % 2 = 0 THEN 1 ELSE -1 END) AS value FROM h GROUP BY ALL)
SELECT p_partkey, CAST(bucket AS INT) AS bucket, round(value / sqrt(sum(value * value) OVER (PARTITION BY p_partkey)), 6) AS value FROM v WHERE abs(value) > 1E-9""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a small file is few tasks, however long its rows take: they are dealt to as many as a shuffle has
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    long = embedding.embed_sparse(parts, "p_name", least=1e-9).select("p_partkey", F.inline("embedding"))
    return long.select("p_partkey", "bucket", F.round("value", 6).alias("value"))


#: Items and tokens of a batch in the packing query: nine tenths of 10,000 tokens a minute.
BATCH = (4, 9000)


@query("batch_packing", f"""WITH RECURSIVE r AS (SELECT conv_id, turn, strlen(text) + 16 AS need, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
p AS (SELECT conv_id, turn, n, need AS held, 1 AS items, 0 AS batch FROM r WHERE n = 1
  UNION ALL SELECT r.conv_id, r.turn, r.n, CASE WHEN p.items >= {BATCH[0]} OR p.held + r.need > {BATCH[1]} THEN r.need ELSE p.held + r.need END,
    CASE WHEN p.items >= {BATCH[0]} OR p.held + r.need > {BATCH[1]} THEN 1 ELSE p.items + 1 END,
    CASE WHEN p.items >= {BATCH[0]} OR p.held + r.need > {BATCH[1]} THEN p.batch + 1 ELSE p.batch END
  FROM p JOIN r ON r.conv_id = p.conv_id AND r.n = p.n + 1)
SELECT conv_id, turn, CAST(batch AS BIGINT) AS batch FROM p""")
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return embedding.packed(rows, "conv_id", "turn", "text", *BATCH).select("conv_id", "turn", "batch")


# -- stored records -----------------------------------------------------------------------
#: Chunks of one index document in the scan query.
INDEX_CHUNKS = 500


@query("local_index_scan", "SELECT 'v' || vec_id AS id, 'd' || label AS document_id, vec_id AS chunk_index, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def local_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents of a bounded number of chunks, written as JSON and read back."""
    chunk = F.struct(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("documentId"), F.col("vec_id").alias("chunkIndex"), F.lit("x").alias("content"), F.col("embedding").cast("array<double>").alias("embedding"))
    docs = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / INDEX_CHUNKS).alias("part")).agg(F.collect_list(chunk).alias("chunks"))
    index = F.to_json(F.struct(F.lit(1).alias("version"), F.lit("local").alias("embeddingProviderId"), F.size(F.col("chunks")[0]["embedding"]).alias("embeddingDimensions"), "chunks"))
    return files.parse_indexes(docs.select(index.alias("json"))).select("id", "document_id", "chunk_index", F.round(F.col("embedding")[0], 6).alias("first"))


@query("entity_decode", """SELECT 'e' || event_id AS id, 'd' || user_id AS document_id, event_id AS chunk_index, CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE -1 END AS page,
CASE WHEN event_id % 2 = 0 THEN event_type END AS section_title, 0 AS dimensions FROM events""")
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored records: numbers as texts, empty optional fields, no vector."""
    text = lambda c: F.col(c).cast("string")
    page = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 7).cast("string")).otherwise("none")
    record = F.struct(F.concat(F.lit("e"), text("event_id")).alias("id"), F.concat(F.lit("d"), text("user_id")).alias("documentId"), F.lit("n").alias("documentName"), text("event_id").alias("chunkIndex"), F.lit("c").alias("content"), page.alias("page"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("").alias("sectionTitle"))
    decoded = files.decode_entities(table(spark, sf_dir, "events").select(F.to_json(record).alias("json")))
    return decoded.select("id", "document_id", "chunk_index", F.coalesce("page", F.lit(-1)).alias("page"), "section_title", F.size("embedding").alias("dimensions"))


@query("error_classify", """SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 429 WHEN event_id % 4 = 1 THEN 403 WHEN event_id % 4 = 2 THEN 503 ELSE 0 END AS INT) AS status,
CASE WHEN event_id % 5 = 0 THEN 'cannotDownloadAbusiveFile' WHEN event_id % 5 = 1 THEN 'exportSizeLimitExceeded' ELSE 'unknown' END AS reason, event_id % 4 IN (0, 2) AS retriable FROM events WHERE event_type = 'error'""")
def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as responses of a service: JSON bodies, broken ones, and none."""
    k = F.col("event_id") % 5
    body = F.when(k == 0, '{"error": {"code": 403, "errors": [{"reason": "x"}, {"reason": "cannotDownloadAbusiveFile"}]}}').when(k == 1, '{"error": {"errors": [{"reason": "exportSizeLimitExceeded"}]}}').when(k == 2, "not json").when(k == 3, '{"error": {"errors": []}}')
    code = lambda at, value: F.when(F.col("event_id") % 4 == at, value)
    status: Column = F.coalesce(code(0, 429), code(1, 403))
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", body.alias("body"), status.alias("response_status"), F.when(F.col("event_id") % 4 < 3, 503).alias("direct_status"))
    silent = rows.withColumn("body", F.when((F.col("event_id") % 4 == 3) & (k == 0), F.replace("body", F.lit('"code": 403, '), F.lit(""))).otherwise(F.col("body")))
    return files.classified(silent).select("event_id", F.coalesce("status", F.lit(0)).alias("status"), "reason", "retriable")


@query("format_bytes", """SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS STRING) || ' B' WHEN n < 1048576 THEN CAST(CAST(CAST(n / 1024.0E0 AS DECIMAL(30, 10)) AS DECIMAL(30, 1)) AS STRING) || ' KiB'
WHEN n < 1073741824 THEN CAST(CAST(CAST(n / 1048576.0E0 AS DECIMAL(30, 10)) AS DECIMAL(30, 1)) AS STRING) || ' MiB' ELSE CAST(CAST(CAST(n / 1073741824.0E0 AS DECIMAL(30, 10)) AS DECIMAL(30, 2)) AS STRING) || ' GiB' END AS label
FROM (SELECT o_orderkey, o_orderkey * o_orderkey * o_orderkey % 5000000000 AS n FROM orders) t""")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("decimal(19,0)")  # a cube of a long key is beyond a long
    n = (key * key % F.lit(5000000000) * key % F.lit(5000000000)).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.bytes_label(n).alias("label"))


# -- evaluation ---------------------------------------------------------------------------
#: Results of a case in the evaluation queries.
AT = 5
EVAL = f"""WITH judged AS (SELECT b.item_id, d.doc_id, 3 AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
near AS (SELECT DISTINCT item_id, doc_id + unnest([0, 1, 2]) AS doc_id FROM judged UNION SELECT item_id, item_id * 3 AS doc_id FROM benchmark),
ranked AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id * 7 % 31, doc_id) AS rank FROM near),
top AS (SELECT r.item_id, r.rank, j.grade, 1.0E0 / r.rank AS score FROM ranked r LEFT JOIN judged j ON j.item_id = r.item_id AND j.doc_id = r.doc_id WHERE r.rank <= {AT}),
ideal AS (SELECT item_id, count(*) AS relevant, sum(CASE WHEN n <= {AT} THEN 7.0E0 / log2(n + 1) END) AS ideal FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n FROM judged) q GROUP BY item_id),
found AS (SELECT item_id, min(CASE WHEN grade >= 2 THEN rank END) AS first, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg, count(*) - count(grade) AS unjudged, max(CASE WHEN rank = 1 THEN score END) AS top_score FROM top GROUP BY item_id),
m AS (SELECT b.item_id, i.item_id IS NULL AS no_answer, CASE WHEN i.item_id IS NOT NULL THEN CASE WHEN first IS NULL THEN 0.0E0 ELSE 1.0E0 END END AS hit,
  CASE WHEN i.item_id IS NOT NULL THEN coalesce(1.0E0 / first, 0.0E0) END AS mrr, CASE WHEN i.item_id IS NOT NULL THEN coalesce(dcg, 0) / ideal END AS ndcg,
  coalesce(dcg, 0.0E0) AS dcg, coalesce(unjudged, 0) AS unjudged, coalesce(relevant, 0) AS judged_relevant, top_score
  FROM benchmark b LEFT JOIN ideal i ON i.item_id = b.item_id LEFT JOIN found f ON f.item_id = b.item_id)"""


def listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, judgments, results): a case for each benchmark item; the documents that contain it are relevant, and
    what is ranked are those, their two successors, and one other document."""
    items = table(spark, sf_dir, "benchmark")
    judged = stored(evaluation.containing(table(spark, sf_dir, "documents"), items).select("item_id", "doc_id"), "judged")  # read four times
    near = judged.select("item_id", F.explode(F.array("doc_id", F.col("doc_id") + 1, F.col("doc_id") + 2)).alias("doc_id")).union(items.select("item_id", F.col("item_id") * 3)).distinct()
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("doc_id") * 7 % 31, "doc_id"))
    results = near.select(F.col("item_id").alias("case_id"), F.col("doc_id").alias("document"), rank.alias("rank")).withColumn("score", 1.0 / F.col("rank"))
    judgments = judged.select(F.col("item_id").alias("case_id"), F.col("doc_id").alias("document"), F.lit(3).alias("grade"))
    answered = judged.select("item_id").distinct().withColumn("answered", F.lit(True))
    cases = items.join(answered, "item_id", "left").select(F.col("item_id").alias("case_id"), F.col("answered").isNull().alias("no_answer"))
    return cases, judgments, results


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate(*listed(spark, sf_dir), AT)


@query("eval_metrics", EVAL + " SELECT item_id, no_answer, hit, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, unjudged, judged_relevant, round(top_score, 6) AS top_score FROM m")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select(F.col("case_id").alias("item_id"), "no_answer", "hit", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"), "unjudged", "judged_relevant", F.round("top_score", 6).alias("top_score"))


@query("eval_dcg", EVAL + " SELECT item_id, round(dcg, 6) AS dcg FROM m")
def eval_dcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select(F.col("case_id").alias("item_id"), F.round("dcg", 6).alias("dcg"))


@query("eval_summary", EVAL + """ SELECT count(*) AS cases, count(*) FILTER (WHERE NOT no_answer) AS answered, count(*) FILTER (WHERE no_answer) AS no_answer, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
round(avg(top_score) FILTER (WHERE no_answer), 6) AS mean_silent_score, round(max(top_score) FILTER (WHERE no_answer), 6) AS max_silent_score FROM m""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.summary(metrics(spark, sf_dir))
    return out.select("cases", "answered", "no_answer", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


@query("rerank_ndcg", EVAL + " SELECT count(*) AS cases, round(avg(ndcg), 6) AS retrieved, true AS better FROM m WHERE NOT no_answer AND item_id % 2 = 1")
def rerank_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean nDCG of cases with odd numbers, and whether a re-ranker trained on the others raises it."""
    cases, judgments, results = listed(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), "text")
    pairs = results.join(items, "case_id").join(docs, "document", "left").join(judgments, ["case_id", "document"], "left")
    labelled = stored(pairs.select("case_id", "document", "query", "text", F.col("grade").isNotNull().cast("int").alias("label")), "pairs")
    ranker = Reranker.trained(labelled.filter("case_id % 2 = 0"))
    scored = labelled.filter("case_id % 2 = 1").select("case_id", "document", ranker.relevance(F.col("query"), F.col("text")).alias("score"))
    again = scored.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "document")))
    odd = cases.filter("case_id % 2 = 1")
    before, after = (evaluation.evaluate(odd, judgments, r.filter("case_id % 2 = 1"), AT).filter("NOT no_answer") for r in (results, again))
    mean = after.agg(F.avg("ndcg").alias("after"))
    return before.agg(F.count("*").alias("cases"), F.avg("ndcg").alias("before")).join(F.broadcast(mean)).select("cases", F.round("before", 6).alias("retrieved"), (F.col("after") > F.col("before")).alias("better"))  # a row each
