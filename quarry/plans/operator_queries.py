"""Queries that apply the analysis, synchronisation and record operators to the driver tables, with
oracles that are written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import expressions as X
from quarry.operators import analysis, records, sync
from quarry.plans.fixtures import CATEGORY, ESTIMATE, FILES, PAIRS, PDF, PPTX, SUPPORTED
from quarry.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        ORACLES[name] = sql
        return run

    return register


# -- analysis -----------------------------------------------------------------------------
TYPED = f"SELECT *, {CATEGORY} AS category, {ESTIMATE} AS est FROM ({FILES}) f"
#: What reading each file gave: a status and measures by formulas of the number of the document.
MEASURES = f"""SELECT id, CASE doc_id % 11 WHEN 0 THEN 'empty_document' WHEN 1 THEN 'permission_error' WHEN 2 THEN 'extraction_failed' WHEN 3 THEN 'skipped_abusive_file'
  WHEN 4 THEN 'export_size_error' WHEN 5 THEN 'file_not_downloadable' ELSE 'success' END AS status, CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 + 1 END AS page_count,
  CASE WHEN mime = '{PPTX}' THEN doc_id % 14 + 1 END AS slide_count, est * 7 % 600 AS chunk_count, size AS extracted_characters, size + 3 AS extracted_bytes,
  size + doc_id % 100 AS chunk_text_characters, size + 2 * (doc_id % 100) AS chunk_text_payload_bytes, 40 * est AS metadata_payload_bytes, est AS metadata_estimated_chunks
  FROM ({TYPED}) t WHERE doc_id % 23 <> 5"""


def analysed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files with their status and measures, pairs of duplicates)."""
    docs = table(spark, sf_dir, "documents")
    files = spark.sql(f"SELECT id, name, mime, category, doc_id FROM ({TYPED}) t", documents=docs)
    pairs = spark.sql(f"WITH files AS ({FILES}) SELECT pdf_id AS id, kept_id FROM ({PAIRS}) p", documents=docs)
    found = spark.sql(MEASURES, documents=docs)
    return analysis.statuses(files, pairs, files.filter("doc_id % 3 <> 1").select("id"), found), pairs


DUCK = f"""WITH files AS ({FILES}), pairs AS ({PAIRS}), typed AS ({TYPED}), found AS ({MEASURES}),
g AS (SELECT t.id, t.category, t.doc_id, p.kept_id AS duplicate_of, f.* EXCLUDE (id, status), CASE WHEN p.pdf_id IS NOT NULL THEN 'duplicate_skipped' WHEN NOT (t.{SUPPORTED}) THEN 'unsupported'
  WHEN t.doc_id % 3 = 1 THEN 'not_sampled' WHEN f.id IS NULL THEN 'extraction_failed' ELSE f.status END AS status
  FROM typed t LEFT JOIN pairs p ON p.pdf_id = t.id LEFT JOIN found f ON f.id = t.id)""".replace("{documents}", "documents")


@query("analysis_statuses", DUCK + " SELECT id, status, duplicate_of, coalesce(chunk_count, -1) AS chunk_count FROM g")
def analysis_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir)[0].select("id", "status", "duplicate_of", F.coalesce("chunk_count", F.lit(-1)).alias("chunk_count"))


def _duck_metric(value: str, name: str) -> str:
    ranks = ", ".join(f"coalesce(quantile_disc({value}, {p}) FILTER (WHERE ok), -1) AS {name}_{label}" for label, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))
    return f"coalesce(CAST(sum({value}) FILTER (WHERE ok) AS BIGINT), 0) AS {name}_total, round(coalesce(avg({value}) FILTER (WHERE ok), 0), 6) AS {name}_average, coalesce(min({value}) FILTER (WHERE ok), -1) AS {name}_min, {ranks}, coalesce(max({value}) FILTER (WHERE ok), -1) AS {name}_max"


def _duck_sum(value: str, where: str = "ok") -> str:
    return f"coalesce(CAST(sum({value}) FILTER (WHERE {where}) AS BIGINT), 0)"


_STATUSES = {"successfully_analyzed": "success", "extraction_failed": "extraction_failed", "skipped_abusive_files": "skipped_abusive_file", "permission_errors": "permission_error", "export_size_errors": "export_size_error", "file_not_downloadable_errors": "file_not_downloadable", "empty_documents": "empty_document"}
_BY_STATUS = ", ".join(f"count(*) FILTER (WHERE status = '{v}') AS {k}" for k, v in _STATUSES.items())
BY_FORMAT = DUCK + f""", h AS (SELECT *, status = 'success' AS ok, status IN ('unsupported', 'duplicate_skipped') AS out_ FROM g),
b AS (SELECT category, count(*) AS total_files, count(*) FILTER (WHERE NOT out_) AS index_target_files, count(*) FILTER (WHERE NOT out_ AND status <> 'not_sampled') AS selected_files, {_BY_STATUS},
  {_duck_sum('extracted_characters')} AS total_extracted_characters, {_duck_sum('extracted_bytes')} AS total_extracted_bytes, {_duck_sum('chunk_text_characters')} AS total_chunk_text_characters,
  {_duck_sum('chunk_text_payload_bytes')} AS tb, {_duck_sum('metadata_payload_bytes')} AS mb, {_duck_sum('metadata_estimated_chunks', "NOT out_ AND status <> 'not_sampled'")} AS metadata_estimated_chunks,
  {_duck_metric('page_count', 'pages')}, {_duck_metric('slide_count', 'slides')}, {_duck_metric('chunk_count', 'chunks')},
  {", ".join(f"count(*) FILTER (WHERE ok AND chunk_count BETWEEN {a + 1} AND {b}) AS le{b}" for a, b in ((-1, 10), (10, 25), (25, 50), (50, 100), (100, 250), (250, 500)))}, count(*) FILTER (WHERE ok AND chunk_count >= 501) AS more
  FROM h GROUP BY category),
c AS (SELECT *, CASE WHEN successfully_analyzed + empty_documents = 0 THEN 1.0E0 ELSE CAST(index_target_files AS DOUBLE) / (successfully_analyzed + empty_documents) END AS scale FROM b),
fs AS (SELECT * EXCLUDE (scale, tb, mb), round(CASE WHEN successfully_analyzed = 0 THEN 0 ELSE CAST(total_extracted_characters AS DOUBLE) / successfully_analyzed END, 6) AS average_characters_per_file,
  round(CASE WHEN chunks_total = 0 THEN 0 ELSE CAST(total_chunk_text_characters AS DOUBLE) / chunks_total END, 6) AS average_characters_per_chunk,
  round(CASE WHEN pages_total > 0 THEN CAST(total_extracted_characters AS DOUBLE) / pages_total END, 6) AS average_characters_per_page,
  round(CASE WHEN slides_total > 0 THEN CAST(total_extracted_characters AS DOUBLE) / slides_total END, 6) AS average_characters_per_slide,
  round(CASE WHEN selected_files = 0 THEN 0 ELSE CAST(metadata_estimated_chunks AS DOUBLE) / selected_files END, 6) AS metadata_estimated_average,
  CAST(floor(chunks_total * scale + 0.5) AS BIGINT) AS projected_chunks, CAST(floor(tb * scale + 0.5) AS BIGINT) AS projected_text_bytes, CAST(floor(mb * scale + 0.5) AS BIGINT) AS projected_metadata_bytes FROM c)"""


@query("analysis_by_format", BY_FORMAT + " SELECT * FROM fs")
def analysis_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.by_format(analysed(spark, sf_dir)[0])
    ranks = tuple(f"_{x}" for x in "min p25 median p75 p90 p95 p99 max".split())  # null, here -1, where nothing was measured
    return out.select(*[F.round(c, 6).alias(c) if "average" in c else F.coalesce(c, F.lit(-1)).alias(c) if c.endswith(ranks) else F.col(c) for c in out.columns])


@query("analysis_corpus", BY_FORMAT + f""" SELECT count(*) AS total_files, count(*) FILTER (WHERE category = 'PDF') AS pdf_files, count(*) FILTER (WHERE category = 'PPTX') AS pptx_files,
count(*) FILTER (WHERE status <> 'unsupported') AS supported_files, (SELECT count(*) FROM pairs) AS duplicate_pairs, count(*) FILTER (WHERE category = 'PDF' AND status = 'duplicate_skipped') AS skipped_duplicate_pdfs,
count(*) FILTER (WHERE NOT out_) AS final_index_target_files, count(*) FILTER (WHERE status = 'unsupported') AS unsupported_files, count(*) FILTER (WHERE NOT out_ AND status <> 'not_sampled') AS selected_for_analysis, {_BY_STATUS},
count(*) FILTER (WHERE status = 'duplicate_skipped') AS duplicate_skipped, count(*) FILTER (WHERE status = 'not_sampled') AS not_sampled, count(*) FILTER (WHERE status = 'not_sampled') > 0 AS is_sampled,
CAST(500 AS BIGINT) AS requested_sample_size, {_duck_sum('chunk_count')} AS measured_chunks, (SELECT CAST(sum(projected_chunks) AS BIGINT) FROM fs) AS projected_total_chunks FROM h""")
def analysis_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, pairs = analysed(spark, sf_dir)
    return analysis.corpus(files, pairs.count(), 500)


@query("analysis_top_files", DUCK + """, u AS (SELECT 'chunk_count' AS ranking, id, chunk_count AS value FROM g WHERE status = 'success' UNION ALL SELECT 'extracted_bytes', id, extracted_bytes FROM g WHERE status = 'success'
UNION ALL SELECT 'page_count', id, page_count FROM g WHERE status = 'success' AND category = 'PDF' UNION ALL SELECT 'slide_count', id, slide_count FROM g WHERE status = 'success' AND category = 'PPTX')
SELECT ranking, CAST(n AS INT) AS rank, id, value FROM (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY value DESC, id) AS n FROM u WHERE value IS NOT NULL) r WHERE n <= 10""")
def analysis_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.top_files(analysed(spark, sf_dir)[0])


# -- synchronisation ----------------------------------------------------------------------
#: Listing, state and outcomes by formulas of the number of the document; one file meets the quota.
LISTED = f"SELECT id, base, mime, parent, doc_id, CAST(CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END AS STRING) AS modified FROM ({FILES}) f WHERE doc_id % 10 <> 8"
KNOWN = f"SELECT id, CAST(doc_id AS STRING) AS modified, doc_id % 4 <> 0 AS is_indexed, CASE WHEN doc_id % 29 = 0 THEN 'other' ELSE 'p' END AS provider, 's' AS store FROM ({FILES}) f WHERE doc_id % 10 <> 9"
RESULT = """CASE WHEN doc_id = 171 THEN 'quota' ELSE CASE doc_id % 13 WHEN 0 THEN 'empty' WHEN 1 THEN 'cannotDownloadAbusiveFile' WHEN 2 THEN 'insufficientFilePermissions' WHEN 3 THEN 'exportSizeLimitExceeded'
  WHEN 4 THEN 'fileNotDownloadable' WHEN 5 THEN 'broken' ELSE 'ok' END END"""
SYNC = f"""WITH listed AS ({LISTED}), known AS ({KNOWN}), pdf AS (SELECT p.id, min(s.id) AS kept_id FROM listed p JOIN listed s ON p.base = s.base AND p.parent = s.parent WHERE p.mime = '{PDF}' AND s.mime = '{PPTX}' GROUP BY p.id),
a AS (SELECT coalesce(l.id, k.id) AS id, l.doc_id, pdf.kept_id, CASE WHEN l.id IS NULL THEN 'removed' WHEN pdf.id IS NOT NULL THEN 'duplicate' WHEN NOT (l.{SUPPORTED}) THEN 'unsupported' WHEN k.id IS NULL THEN 'new'
  WHEN k.is_indexed AND k.provider = 'p' AND k.modified = l.modified THEN 'skip' ELSE 'updated' END AS action FROM listed l FULL JOIN known k ON k.id = l.id LEFT JOIN pdf ON pdf.id = l.id),
r AS (SELECT *, CASE WHEN action IN ('new', 'updated') THEN {RESULT} END AS result FROM a), stop AS (SELECT min(doc_id) AS stop FROM r WHERE result = 'quota'),
t AS (SELECT r.* EXCLUDE (result), action IN ('new', 'updated', 'skip') AND coalesce(doc_id > stop, false) AS late, CASE WHEN NOT (coalesce(doc_id > stop, false)) THEN result END AS result FROM r, stop),
c AS (SELECT id, result, k, (doc_id + k) % 3 = 0 AS reused FROM (SELECT *, unnest(range(0, 1 + doc_id % 45)) AS k FROM t WHERE result IN ('ok', 'quota')) x),
b AS (SELECT id, result, k // 20 AS batch, count(*) FILTER (WHERE NOT reused) AS missing FROM c GROUP BY ALL HAVING count(*) FILTER (WHERE NOT reused) > 0),
s AS (SELECT id, count(*) AS batches, CAST(sum(missing) AS BIGINT) AS inputs FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch) AS n FROM b) y WHERE result = 'ok' OR n = 1 GROUP BY id),
fin AS (SELECT t.*, coalesce(s.batches, 0) AS batches, coalesce(s.inputs, 0) AS inputs, coalesce(u.reused, 0) AS reused_chunks FROM t LEFT JOIN s ON s.id = t.id LEFT JOIN (SELECT id, count(*) FILTER (WHERE reused) AS reused FROM c GROUP BY id) u ON u.id = t.id)""".replace("{documents}", "documents")


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    listing = spark.sql(f"SELECT id, base, mime, array(parent) AS parents, modified, doc_id AS ordinal FROM ({LISTED}) l", documents=docs)
    outcomes = spark.sql(f"SELECT id, {RESULT} AS result, transform(sequence(0, CAST(doc_id % 45 AS INT)), k -> (doc_id + k) % 3 = 0) AS reused FROM ({FILES}) f", documents=docs)
    return sync.run_files(listing, spark.sql(KNOWN, documents=docs), outcomes, "p", "s")


@query("sync_run_files", SYNC + """ SELECT id, action, kept_id, result, late, action = 'skip' OR coalesce(result = 'ok', false) AS is_indexed,
action IN ('duplicate', 'removed') OR coalesce(result NOT IN ('ok', 'quota', 'broken'), false) AS clears, reused_chunks, CASE WHEN result = 'ok' THEN inputs ELSE 0 END AS embedded_chunks, batches, inputs FROM fin""")
def sync_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synced(spark, sf_dir)


@query("sync_run", SYNC + """ SELECT count(*) FILTER (WHERE action = 'new' AND result = 'ok') AS new, count(*) FILTER (WHERE action = 'updated' AND result = 'ok') AS updated, count(*) FILTER (WHERE action = 'skip' AND NOT late) AS skipped,
count(*) FILTER (WHERE action = 'duplicate') AS duplicates, count(*) FILTER (WHERE result IN ('quota', 'broken', 'insufficientFilePermissions', 'exportSizeLimitExceeded', 'fileNotDownloadable')) AS failed,
count(*) FILTER (WHERE action = 'removed') AS removed, count(*) FILTER (WHERE action = 'unsupported') AS unsupported, count(*) FILTER (WHERE result = 'cannotDownloadAbusiveFile') AS skipped_abusive_files,
count(*) FILTER (WHERE result = 'empty') AS skipped_empty_documents, count(*) FILTER (WHERE result = 'insufficientFilePermissions') AS permission_errors, count(*) FILTER (WHERE result = 'exportSizeLimitExceeded') AS export_size_errors,
count(*) FILTER (WHERE result = 'fileNotDownloadable') AS file_not_downloadable_errors, coalesce(bool_or(result = 'quota'), false) AS embedding_quota_exhausted,
count(*) FILTER (WHERE action IN ('new', 'updated') AND (late OR result = 'quota')) AS deferred, coalesce(CAST(sum(inputs) FILTER (WHERE result = 'ok') AS BIGINT), 0) AS embedded_chunks,
CAST(sum(reused_chunks) AS BIGINT) AS reused_chunks, CAST(sum(batches) AS BIGINT) AS embedding_batch_attempts, CAST(sum(inputs) AS BIGINT) AS embedding_input_attempts FROM fin""")
def sync_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighteen counters of a run."""
    return sync.run_counters(synced(spark, sf_dir))


# -- records ------------------------------------------------------------------------------
GIVEN = """SELECT event_id AS ordinal, CAST(user_id AS STRING) AS user_id, CASE WHEN event_id % 41 = 0 THEN '' ELSE 'l' || CAST(event_id % 500 AS STRING) END AS log_id, 'd' || CAST(event_id % 3 AS STRING) AS document_id,
  'c' || CAST(event_id AS STRING) AS chunk_id, CAST(event_id % 23 AS INT) AS rank, CASE WHEN event_id % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS score,
  CASE event_type WHEN 'click' THEN 'positive' WHEN 'error' THEN 'negative' ELSE event_type END AS feedback, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'slack' END AS source FROM {events}"""
LOGS = "SELECT DISTINCT 'l' || CAST(event_id % 500 AS STRING) AS log_id, CAST(user_id AS STRING) AS user_id FROM {events} WHERE event_id % 3 <> 0"
STORED = "SELECT user_id, log_id, document_id FROM ({given}) s WHERE ordinal % 7 = 0"


@query("feedback_append", f"""WITH given AS ({GIVEN}), logs AS ({LOGS}), stored AS ({STORED.replace('({given}) s', 'given')}),
ok AS (SELECT g.* FROM given g WHERE log_id <> '' AND rank >= 1 AND rank <= 20 AND score IS NOT NULL AND NOT isnan(score) AND feedback IN ('positive', 'negative') AND (log_id, user_id) IN (SELECT (log_id, user_id) FROM logs)
  AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = g.user_id AND s.log_id = g.log_id AND s.document_id = g.document_id))
SELECT min(ordinal) AS ordinal, user_id, log_id, document_id FROM ok GROUP BY user_id, log_id, document_id""".replace("{events}", "events"))
def feedback_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    given = spark.sql(GIVEN, events=events)
    stored = given.filter("ordinal % 7 = 0").select("user_id", "log_id", "document_id")
    return records.accepted_feedback(given, stored, spark.sql(LOGS, events=events)).select("ordinal", "user_id", "log_id", "document_id")


@query("metadata_upsert", f"""WITH files AS ({FILES}), old AS (SELECT 'row' || CAST(doc_id AS STRING) AS id, id AS k, name, true AS is_active FROM files WHERE doc_id % 10 <> 9), new AS (SELECT id AS k, 'n-' || name AS name FROM files WHERE doc_id % 10 <> 8)
SELECT coalesce(old.id, 'doc-' || left(sha256(new.k), 16)) AS id, coalesce(new.k, old.k) AS drive_file_id, coalesce(new.name, old.name) AS name, old.id IS NOT NULL AS is_active FROM old FULL JOIN new ON new.k = old.k""".replace("{documents}", "documents"))
def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.sql(FILES, documents=table(spark, sf_dir, "documents"))
    stored = files.filter("doc_id % 10 <> 9").selectExpr("concat('row', doc_id) AS id", "id AS drive_file_id", "name", "true AS is_active")
    updates = files.filter("doc_id % 10 <> 8").selectExpr("id AS drive_file_id", "concat('n-', name) AS name")
    return records.upserted_documents(stored, updates).withColumn("is_active", F.coalesce("is_active", F.lit(False)))


@query("constraint_violations", """SELECT 'unique user_id, event_type' AS rule, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1) x
UNION ALL SELECT 'check value', count(*) FILTER (WHERE value > 50) FROM events UNION ALL SELECT 'parent of user_id', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return records.violations(events, [["user_id", "event_type"]], {"value": F.col("value") <= 50}, {"user_id": (table(spark, sf_dir, "customer"), "c_custkey")})


# -- labels -------------------------------------------------------------------------------
@query("result_labels", f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'RRF統合スコア' WHEN 1 THEN 'コサイン類似度' ELSE '関連度' END AS label, round(least(1, CASE doc_id % 3 WHEN 0 THEN (doc_id % 50 / 1000.0E0) / (2.0E0 / 61) ELSE doc_id % 50 / 1000.0E0 END), 6) AS score,
CASE WHEN doc_id % 4 = 0 THEN 'Page ' || doc_id WHEN doc_id % 4 = 1 THEN 'Slide ' || doc_id ELSE source END AS place, CASE WHEN mime = '{PDF}' THEN 'PDF' WHEN mime LIKE '%presentation%' THEN 'SLIDES' WHEN mime LIKE '%document%' THEN 'DOC' ELSE CASE WHEN name LIKE '%.pdf' THEN 'PDF' WHEN name LIKE '%.pptx' THEN 'SLIDES' WHEN name LIKE '%.docx' THEN 'DOC' ELSE 'FILE' END END AS format,
'document-' || left(sha256(id || chr(0) || coalesce(text, '')), 16) AS document_id, CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END AS cell
FROM (SELECT f.*, d.source FROM ({FILES}) f JOIN documents d ON d.doc_id = f.doc_id) x""".replace("{documents}", "documents"))
def result_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a result's score, place, format, identity and report cell."""
    docs = table(spark, sf_dir, "documents")
    files = spark.sql(FILES, documents=docs).join(docs.select("doc_id", "source"), "doc_id")
    kind, n = F.col("doc_id") % 3, F.col("doc_id") % 4
    kind = F.when(kind == 0, "rrf").when(kind == 1, "cosine")
    place = X.location_label(F.when(n == 0, F.col("doc_id")), F.when(n == 1, F.col("doc_id")), F.col("source"))
    score = X.display_score(F.col("doc_id") % 50 / 1000.0, F.coalesce(kind, F.lit("")))
    return files.select("doc_id", X.score_label(kind).alias("label"), F.round(score, 6).alias("score"), place.alias("place"), X.document_format(F.col("name"), F.col("mime")).alias("format"),
                        X.document_id(F.col("id"), F.coalesce("text", F.lit(""))).alias("document_id"), X.csv_value(F.col("text")).alias("cell"))


