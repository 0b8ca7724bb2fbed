"""Queries on stored records, logs, chat messages, measures and listings in locale order, with their
SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.expressions import embedding_input
from quarry.operators import analysis, listing, records
from quarry.operators.committed import Change, Store, Table
from quarry.operators.store import Identity
from quarry.plans.fixtures import CHUNKS, DOCX, FILES, PDF, PPTX, SLIDES
from quarry.session import scratch, table
from quarry.sources import files as sources
from quarry.sources.tree import contents, tree
from quarry.streaming.continuous import searches_by_window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        ORACLES[name] = sql
        return run

    return register


# -- logs ---------------------------------------------------------------------------------
LOGS = {"logs": Table("id string, request_id long, user_id long, source string, query string, result_count long", "id", "id")}
SEARCHES = "SELECT event_id AS request_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'slack' END AS source, event_type AS query FROM {events} WHERE event_type IN ('view', 'click')"


@query("search_logs", """SELECT 'log-' || left(sha256(CAST(event_id AS VARCHAR) || chr(0) || CAST(user_id AS VARCHAR) || chr(0) || event_type), 16) AS id, event_id AS request_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'slack' END AS source, event_type AS query,
CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 4 END AS result_count FROM events WHERE event_type IN ('view', 'click')""")
def search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches logged with the number of their results, appended in batches of which one comes again."""
    searches = spark.sql(SEARCHES, events=table(spark, sf_dir, "events"))
    found = searches.filter("request_id % 5 <> 0").select("request_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).filter("n <= request_id % 4")
    store = Store(spark, scratch(spark, "logs"), Identity("logs", 1), LOGS, buckets=8)
    for batch in (0, 1, 1):
        part = searches.filter(f"request_id % 2 = {batch}")
        store.commit({"logs": Change(upserts=records.logged(part, found))}, stream="searches", batch=batch)
    return store.read("logs").select("id", "request_id", "user_id", "source", "query", "result_count")


@query("searches_by_window", """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'slack' END AS source, count(*) AS searches FROM events WHERE event_type = 'view' GROUP BY 1, 2""")
def searches_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of each day and source, of the events read as a stream."""
    events = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    folder, out = scratch(spark, "events"), scratch(spark, "windows")
    events.write.parquet(folder)
    logs = spark.readStream.schema(events.schema).parquet(folder).withColumn("source", F.expr("CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'slack' END"))
    name = f"windows_{out[-12:]}"
    counted = searches_by_window(logs, "1 day", "1 day")
    running = counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", out).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "source", "searches")


# -- records ------------------------------------------------------------------------------
@query("state_changes", f"""SELECT id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 ELSE true END AS is_indexed, CASE WHEN doc_id % 6 = 3 THEN 'f1' END AS duplicate_of, doc_id % 9 <> 0 AS is_active, name FROM ({FILES.replace('{documents}', 'documents')}) f""")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of records changed by id; a state that is set to null becomes null."""
    files = spark.sql(f"SELECT id, doc_id, name FROM ({FILES}) f", documents=table(spark, sf_dir, "documents"))
    held = files.select("id", F.lit(True).alias("is_indexed"), F.lit(None).cast("string").alias("duplicate_of"), F.lit(True).alias("is_active"), "name")
    changes = files.filter("doc_id % 3 = 0").select("id", F.expr("doc_id % 2 = 0").alias("is_indexed"), F.expr("CASE WHEN doc_id % 6 = 3 THEN 'f1' END").alias("duplicate_of"), F.expr("doc_id % 9 <> 0").alias("is_active"))
    return records.with_states(held, changes)


@query("feedback_actions", """WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'log' || CAST(event_id AS VARCHAR) END AS log, 'd' || CAST(user_id AS VARCHAR) AS document, CAST(event_id % 25 AS INT) AS rank, value, CASE event_type WHEN 'click' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'other' END AS feedback FROM events)
SELECT event_id, log AS log_id, document AS document_id, rank, round(value, 6) AS score, feedback FROM e WHERE log <> '' AND rank >= 1 AND value IS NOT NULL AND feedback <> 'other'""")
def feedback_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of feedback buttons written and read back; what lacks a field, or has a wrong one, is no action."""
    e = table(spark, sf_dir, "events").withColumn("log", F.expr("CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('log', CAST(event_id AS STRING)) END")).withColumn("document", F.concat(F.lit("d"), F.col("user_id").cast("string")))
    feedback = F.expr("CASE event_type WHEN 'click' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'other' END")
    value = records.action_value(F.col("log"), F.col("document"), F.concat(F.col("document"), F.lit(":0")), (F.col("event_id") % 25).cast("int"), F.col("value"), feedback)
    read = e.select("event_id", records.read_action(value).alias("x")).filter("x IS NOT NULL")
    return read.select("event_id", F.col("x.searchLogId").alias("log_id"), F.col("x.documentId").alias("document_id"), F.col("x.rank").alias("rank"), F.round("x.score", 6).alias("score"), F.col("x.feedback").alias("feedback"))


@query("direct_queries", """SELECT conv_id, turn, 'u' || CAST(conv_id % 5 AS VARCHAR) AS user_id, trim(text, ' ') AS query FROM conversations WHERE conv_id % 4 <> 1 AND turn % 3 <> 2 AND role <> 'assistant' AND conv_id % 5 <> 0 AND text IS NOT NULL""")
def direct_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that a person sent to the bot alone: of a direct channel, without a subtype, not a bot's, of a user, with a text."""
    said = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.expr("CASE WHEN conv_id % 4 = 1 THEN 'channel' ELSE 'im' END").alias("channel_type"), F.expr("CASE WHEN turn % 3 = 2 THEN 'message_changed' END").alias("subtype"),
        F.expr("CASE WHEN role = 'assistant' THEN 'b1' END").alias("bot_id"), F.expr("CASE WHEN conv_id % 5 = 0 THEN '' ELSE concat('u', CAST(conv_id % 5 AS STRING)) END").alias("user"))
    return records.direct_messages(said).select("conv_id", "turn", "user_id", "query")


# -- failures, measures, routes -----------------------------------------------------------
@query("failure_decisions", """WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'cannotDownloadAbusiveFile' WHEN 1 THEN 'insufficientFilePermissions' WHEN 2 THEN 'exportSizeLimitExceeded' WHEN 3 THEN 'fileNotDownloadable' WHEN 4 THEN 'unknown' END AS reason,
CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 500 + event_id % 90 END AS status, CASE WHEN event_id % 8 = 3 THEN 'ECONNRESET' WHEN event_id % 8 = 7 THEN 'EPIPE' END AS code FROM events)
SELECT event_id, CASE reason WHEN 'cannotDownloadAbusiveFile' THEN 'skipped_abusive_file' WHEN 'insufficientFilePermissions' THEN 'permission_error' WHEN 'exportSizeLimitExceeded' THEN 'export_size_error' WHEN 'fileNotDownloadable' THEN 'file_not_downloadable' ELSE 'extraction_failed' END AS status,
coalesce(status = 429 OR status >= 500, false) OR coalesce(code = 'ECONNRESET', false) AS again FROM e""")
def failure_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each failure makes of its file, and whether it is worth another attempt."""
    e = table(spark, sf_dir, "events")
    reason = F.expr("CASE event_id % 6 WHEN 0 THEN 'cannotDownloadAbusiveFile' WHEN 1 THEN 'insufficientFilePermissions' WHEN 2 THEN 'exportSizeLimitExceeded' WHEN 3 THEN 'fileNotDownloadable' WHEN 4 THEN 'unknown' END")
    status = F.expr("CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 500 + event_id % 90 END")
    code = F.expr("CASE WHEN event_id % 8 = 3 THEN 'ECONNRESET' WHEN event_id % 8 = 7 THEN 'EPIPE' END")
    return e.select("event_id", analysis.failure_status(reason).alias("status"), analysis.may_retry(status, code).alias("again"))


@query("chunk_measures", """WITH c AS (SELECT 'f' || CAST(doc_id % 50 AS VARCHAR) AS id, coalesce(text, '') AS content FROM documents)
SELECT id, count(*) AS chunk_count, CAST(sum(length(content)) AS BIGINT) AS chunk_text_characters, CAST(sum(strlen(content)) AS BIGINT) AS chunk_text_payload_bytes, CAST(sum(strlen(id) + 14) AS BIGINT) AS metadata_payload_bytes FROM c GROUP BY id""")
def chunk_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chunks of each file take, and what is written around them."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("document_id"), F.coalesce("text", F.lit("")).alias("content"))
    return analysis.measured(docs.withColumn("payload", F.concat(F.lit('{"id":"'), "document_id", F.lit('","'), "content", F.lit('"'), F.lit("}"), F.lit("  "))))


@query("section_measures", f"""WITH f AS (SELECT id, mime, coalesce(text, '') AS text, doc_id FROM ({FILES.replace('{documents}', 'documents')}) x)
SELECT id, CASE mime WHEN '{PDF}' THEN 'pdf' WHEN '{PPTX}' THEN 'pptx' WHEN '{SLIDES}' THEN 'slides' WHEN '{DOCX}' THEN 'docx' END AS extractor, CAST(length(text) + 3 AS BIGINT) AS characters, CAST(strlen(text) + 3 AS BIGINT) AS bytes,
CAST(CASE WHEN doc_id % 3 = 0 THEN 9 WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS INT) AS pages FROM f""")
def section_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extractor of each file, the size of its sections, and its pages: counted, else named by them."""
    f = spark.sql(f"SELECT id, mime, coalesce(text, '') AS text, doc_id FROM ({FILES}) x", documents=table(spark, sf_dir, "documents"))
    page = lambda k: F.expr(f"CASE WHEN doc_id % 3 < 2 THEN {k} END").alias("page")
    said = f.withColumn("sections", F.array(F.struct("text", page(1)), F.struct(F.lit("end").alias("text"), page(2)), F.struct(F.lit("").alias("text"), page(1))))
    characters, size = analysis.extracted_sizes(F.col("sections"))
    counted = F.expr("CASE WHEN doc_id % 3 = 0 THEN 9 END")
    return said.select("id", sources.extractor_of(F.col("mime")).alias("extractor"), characters.alias("characters"), size.alias("bytes"), F.coalesce(sources.structural_count(F.col("sections"), "page", counted), F.lit(0)).alias("pages"))


@query("storage_report", """WITH b AS (SELECT (SELECT count(*) FROM embeddings) AS n, (SELECT CAST(sum(strlen(coalesce(text, ''))) AS DOUBLE) FROM documents) AS t, (SELECT CAST(sum(40 * length(url)) AS DOUBLE) FROM pages) AS m),
x AS (SELECT *, n * 256.0 + t + m AS base FROM b), k AS (SELECT unnest([1.0, 1.5, 2.0, 3.0]) AS factor)
SELECT CAST(factor AS DOUBLE) AS factor, round(CAST(base * factor AS DOUBLE), 3) AS bytes, round(CAST(100 * base * factor / 50000000 AS DOUBLE), 6) AS percent, round(CAST(greatest(0, 50000000 - base * factor) AS DOUBLE), 3) AS remaining,
CAST(floor(50000000 / (base / n * factor)) AS BIGINT) AS most_chunks, CASE WHEN 300 * base / 50000000 < 25 THEN 'LOW RISK' WHEN 300 * base / 50000000 < 60 THEN 'MODERATE RISK' ELSE 'HIGH RISK' END AS risk, CAST(n * 256 AS DOUBLE) AS vector_bytes, t AS text_bytes, m AS metadata_bytes FROM x, k""")
def storage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What vectors, texts and metadata take, at four sizes, and how many chunks a capacity of 50 MB holds."""
    one = lambda name, value: table(spark, sf_dir, name).agg(F.sum(F.expr(value)).cast("long").alias("x")).first()["x"] or 0
    found = analysis.storage(table(spark, sf_dir, "embeddings").count(), one("documents", "octet_length(coalesce(text, ''))"), one("pages", "40 * length(url)"), 64, 50_000_000)
    names = ("factor", "bytes", "percent", "remaining", "most_chunks", "risk", "vector_bytes", "text_bytes", "metadata_bytes")
    whole = spark.createDataFrame([tuple(float(r[n]) if n not in ("risk", "most_chunks") else r[n] for n in names) for r in found], ", ".join(f"{n} {'string' if n == 'risk' else 'long' if n == 'most_chunks' else 'double'}" for n in names))
    return whole.withColumns({"bytes": F.round("bytes", 3), "percent": F.round("percent", 6), "remaining": F.round("remaining", 3)})


@query("embedding_inputs", f"""SELECT id, CASE WHEN parent <> 'folder0' THEN parent || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS input FROM ({FILES.replace('{documents}', 'documents')}) f""")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of a chunk: its text, below the title of its section if it has one."""
    f = spark.sql(f"SELECT id, CASE WHEN parent <> 'folder0' THEN parent END AS title, coalesce(text, '') AS text FROM ({FILES}) f", documents=table(spark, sf_dir, "documents"))
    return f.select("id", embedding_input(F.col("title"), F.col("text")).alias("input"))


# -- index documents ----------------------------------------------------------------------
@query("local_index_round_trip", f"SELECT document_id || ':' || CAST(chunk_index AS VARCHAR) AS id, document_id, CAST(chunk_index AS BIGINT) AS chunk_index, 'label ' || CAST(label AS VARCHAR) AS content, 64 AS dimensions FROM ({CHUNKS.replace('{embeddings}', 'embeddings')}) c")
def local_index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks written as index documents, which replace those there were, and read back."""
    rows = spark.sql(CHUNKS, embeddings=table(spark, sf_dir, "embeddings"))
    chunks = rows.select(F.concat_ws(":", "document_id", F.col("chunk_index").cast("string")).alias("id"), "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("content"), F.col("embedding").cast("array<double>").alias("embedding"))
    folder = scratch(spark, "index")
    for part in (chunks.limit(3), chunks):
        sources.write_index(part, folder, "p", 64, parts=4)
    back = sources.local_index(spark, folder)
    return back.select("id", F.col("documentId").alias("document_id"), F.col("chunkIndex").alias("chunk_index"), "content", F.size("embedding").alias("dimensions"))


# -- locale order -------------------------------------------------------------------------
NAMED = "SELECT c_custkey AS id, c_nationkey AS folder, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name WHEN 2 THEN replace(lower(n_name), 'a', 'ä') ELSE 'É' || lower(substr(n_name, 2)) END || ' ' || CAST(c_custkey % 13 AS STRING) AS name FROM {customer} JOIN {nation} ON n_nationkey = (c_custkey * 7) % 25"


@query("locale_listing", f"SELECT id, folder, name, CAST(row_number() OVER (PARTITION BY folder ORDER BY name COLLATE en, id) AS INT) AS place FROM ({NAMED.replace('{customer}', 'customer').replace('{nation}', 'nation')}) f")
def locale_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each folder in the order of their names as people sort them: letters before marks and case."""
    files = spark.sql(NAMED, customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))
    return listing.in_locale_order(files, "folder", "name", "id")


# -- a tree as a source -------------------------------------------------------------------
@query("tree_listing", "SELECT 'nation=' || CAST(c_nationkey AS VARCHAR) AS parent, 'text/plain' AS mime, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS size, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS held FROM customer WHERE c_nationkey IN (3, 5, 8) GROUP BY c_nationkey")
def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, a folder for each nation, listed by the data source with filters that it takes over,
    and read: sizes as listed and as read."""
    folder = scratch(spark, "tree")
    rows = table(spark, sf_dir, "customer").select("c_name", F.col("c_nationkey").alias("nation"))
    rows.repartition("nation").write.partitionBy("nation").text(folder)
    files = tree(spark, folder).filter(F.col("mime") == "text/plain").filter(F.col("parent").isin("nation=3", "nation=5", "nation=8"))
    read = contents(spark, folder, files)
    return read.groupBy("parent", "mime").agg(F.sum("size").alias("size"), F.sum(F.length("content").cast("long")).alias("held"))
