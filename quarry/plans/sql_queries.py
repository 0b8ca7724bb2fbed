"""Relational queries: one text for Spark and DuckDB, or two where dialects differ."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.fixtures import CATEGORY, CHUNKS, DOCS, ESTIMATE, FILES, PAIRS, PPTX, SLIDES, SUPPORTED, snapshot
from quarry.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def both(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """Register a query; ``{table}`` stands for a driver table."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", spark_sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in tables})

    QUERIES[name] = run
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", duck_sql or spark_sql)


WITH = f"WITH files AS ({FILES}), pairs AS ({PAIRS}), typed AS (SELECT *, {CATEGORY} AS category, {ESTIMATE} AS est FROM files)"
KEPT = "kept AS (SELECT * FROM typed t WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.pdf_id = t.id))"

# -- listing, validation, routing ---------------------------------------------------------
both("folder_closure", """
WITH RECURSIVE edges AS (SELECT 'n' || CAST(n_nationkey AS STRING) AS id, 'r' || CAST(n_regionkey AS STRING) AS parent, n_name AS name FROM {nation}
  UNION ALL SELECT 'r' || CAST(r_regionkey AS STRING), 'root', r_name FROM {region}),
walk AS (SELECT id, parent, name, 1 AS depth FROM edges WHERE parent = 'root'
  UNION ALL SELECT e.id, e.parent, e.name, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.id)
SELECT id, parent, name, CAST(depth AS INT) AS depth FROM walk""")
both("source_validate", WITH + """
SELECT id, name, coalesce(NULLIF(parent, 'folder0'), '') AS parent, CAST(size AS BIGINT) AS size,
  id IS NOT NULL AND name <> '' AND mime IS NOT NULL AS valid FROM files""")
both("fetch_routing", WITH + f"""
SELECT id, CASE WHEN mime = '{SLIDES}' THEN 'slides_api' WHEN mime = '{DOCS}' THEN 'export' ELSE 'download' END AS strategy,
  CASE WHEN mime = '{DOCS}' THEN 'docx' ELSE mime END AS content_mime FROM files""")
both("point_lookup", WITH + " SELECT id, name, mime, parent, size FROM files WHERE id = 'f0000042'")
both("keyed_chunk_scan", f"WITH chunks AS ({CHUNKS}) SELECT document_id, chunk_index, vec_id FROM chunks WHERE document_id = 'd7'")
both("active_scan", WITH + f" SELECT id, name, mime FROM files WHERE {SUPPORTED} AND doc_id % 10 <> 9")
# -- duplicates and analysis --------------------------------------------------------------
both("dedupe_pairs", WITH + " SELECT pdf_id, kept_id FROM pairs")
both("dedupe_kept", WITH + f", {KEPT} SELECT id, category FROM kept")
both("category_counts", WITH + """
, names AS (SELECT * FROM (VALUES ('PDF'), ('PPTX'), ('Google Slides'), ('DOCX'), ('Google Docs'), ('Other')) AS v(category))
SELECT n.category, count(t.id) AS files FROM names n LEFT JOIN typed t ON t.category = n.category GROUP BY n.category""")
both("overview_totals", WITH + f"""
SELECT count(*) AS files, count(CASE WHEN {SUPPORTED} THEN 1 END) AS supported, (SELECT count(*) FROM pairs) AS duplicates,
  CAST(sum(CASE WHEN {SUPPORTED} THEN est ELSE 0 END) AS BIGINT) AS chunks,
  CAST(sum(CASE WHEN {SUPPORTED} THEN est ELSE 0 END) * 768 * 4 AS BIGINT) AS bytes FROM typed""")
both("metric_summary", WITH + """
SELECT category, CAST(sum(size) AS BIGINT) AS total, round(avg(size), 6) AS average, min(size) AS least,
  CAST(percentile_disc(0.25) WITHIN GROUP (ORDER BY size) AS BIGINT) AS p25, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY size) AS BIGINT) AS median,
  CAST(percentile_disc(0.75) WITHIN GROUP (ORDER BY size) AS BIGINT) AS p75, CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY size) AS BIGINT) AS p90,
  CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY size) AS BIGINT) AS p95, CAST(percentile_disc(0.99) WITHIN GROUP (ORDER BY size) AS BIGINT) AS p99, max(size) AS most
FROM typed GROUP BY category""", WITH + """
SELECT category, CAST(sum(size) AS BIGINT) AS total, round(avg(size), 6) AS average, min(size) AS least,
  quantile_disc(size, 0.25) AS p25, quantile_disc(size, 0.5) AS median, quantile_disc(size, 0.75) AS p75, quantile_disc(size, 0.9) AS p90,
  quantile_disc(size, 0.95) AS p95, quantile_disc(size, 0.99) AS p99, max(size) AS most FROM typed GROUP BY category""")
both("percentiles", """
WITH n AS (SELECT l_orderkey, count(*) AS v FROM {lineitem} GROUP BY l_orderkey)
SELECT min(v) AS least, CAST(percentile_disc(0.25) WITHIN GROUP (ORDER BY v) AS BIGINT) AS p25, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY v) AS BIGINT) AS median,
  CAST(percentile_disc(0.75) WITHIN GROUP (ORDER BY v) AS BIGINT) AS p75, CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY v) AS BIGINT) AS p90,
  CAST(percentile_disc(0.99) WITHIN GROUP (ORDER BY v) AS BIGINT) AS p99, max(v) AS most FROM n""")
both("histogram", """
WITH n AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS v FROM {lineitem} GROUP BY l_orderkey)
SELECT count(CASE WHEN v <= 10 THEN 1 END) AS le10, count(CASE WHEN v > 10 AND v <= 25 THEN 1 END) AS le25,
  count(CASE WHEN v > 25 AND v <= 50 THEN 1 END) AS le50, count(CASE WHEN v > 50 AND v <= 100 THEN 1 END) AS le100,
  count(CASE WHEN v > 100 AND v <= 250 THEN 1 END) AS le250, count(CASE WHEN v > 250 AND v <= 500 THEN 1 END) AS le500,
  count(CASE WHEN v > 500 THEN 1 END) AS more FROM n""")
both("status_assembly", WITH + f"""
SELECT t.id, t.category, CASE WHEN p.pdf_id IS NOT NULL THEN 'duplicate' WHEN NOT ({SUPPORTED}) THEN 'unsupported'
  WHEN t.doc_id % 3 = 1 THEN 'not_sampled' WHEN t.size = 0 THEN 'empty' ELSE 'success' END AS status, p.kept_id AS duplicate_of
FROM typed t LEFT JOIN pairs p ON p.pdf_id = t.id""")
STATUS = WITH + f""", s AS (SELECT t.*, CASE WHEN p.pdf_id IS NOT NULL THEN 'duplicate' WHEN NOT ({SUPPORTED}) THEN 'unsupported'
  WHEN t.doc_id % 3 = 1 THEN 'not_sampled' WHEN t.size < 100 THEN 'empty' ELSE 'success' END AS status
  FROM typed t LEFT JOIN pairs p ON p.pdf_id = t.id)"""
FORMAT = """f AS (SELECT category, count(*) AS files, count(CASE WHEN status IN ('success', 'empty', 'not_sampled') THEN 1 END) AS targets,
  count(CASE WHEN status IN ('success', 'empty') THEN 1 END) AS effective, count(CASE WHEN status = 'success' THEN 1 END) AS success,
  CAST(sum(CASE WHEN status = 'success' THEN est ELSE 0 END) AS BIGINT) AS chunks,
  CAST(sum(CASE WHEN status = 'success' THEN size ELSE 0 END) AS BIGINT) AS chars FROM s GROUP BY category)"""
PROJECTED = "CASE WHEN effective > 0 THEN CAST(floor(chunks * CAST(targets AS DOUBLE) / effective + 0.5) AS BIGINT) ELSE 0 END"
both("format_summary", STATUS + f", {FORMAT} SELECT *, {PROJECTED} AS projected_chunks FROM f")
both("corpus_summary", STATUS + """
SELECT count(*) AS files, count(CASE WHEN status = 'success' THEN 1 END) AS success, count(CASE WHEN status = 'empty' THEN 1 END) AS empty,
  count(CASE WHEN status = 'duplicate' THEN 1 END) AS duplicates, count(CASE WHEN status = 'unsupported' THEN 1 END) AS unsupported,
  count(CASE WHEN status = 'not_sampled' THEN 1 END) AS not_sampled, count(CASE WHEN status = 'not_sampled' THEN 1 END) > 0 AS is_sampled FROM s""")
both("projected_totals", STATUS + f", {FORMAT} SELECT CAST(sum(chunks) AS BIGINT) AS measured, CAST(sum({PROJECTED}) AS BIGINT) AS projected FROM f")
SCENARIOS = WITH + """
, b AS (SELECT CAST(sum(est) AS BIGINT) * 768 * 4 + CAST(sum(size) AS BIGINT) AS base FROM typed),
k AS (SELECT * FROM (VALUES (1.0), (1.5), (2.0), (3.0)) AS v(factor))
SELECT CAST(factor AS DOUBLE) AS factor, CAST(base * CAST(factor AS DOUBLE) AS BIGINT) AS bytes,
  round(base * CAST(factor AS DOUBLE) / 5368709120 * 100, 6) AS percent,
  CAST(greatest(0, 5368709120 - base * CAST(factor AS DOUBLE)) AS BIGINT) AS remaining,
  CASE WHEN base = 0 THEN 'NO DATA' WHEN base * 3.0 / 5368709120 * 100 < 25 THEN 'LOW RISK' WHEN base * 3.0 / 5368709120 * 100 < 60 THEN 'MODERATE RISK'
    ELSE 'HIGH RISK' END AS risk FROM b, k"""
# DuckDB casts a double to the nearest whole number, ties to even; Spark cuts it off
both("storage_scenarios", SCENARIOS.replace("CAST(base * CAST(factor AS DOUBLE) AS BIGINT)", "CAST(rint(base * CAST(factor AS DOUBLE)) AS BIGINT)")
  .replace("CAST(greatest(0, 5368709120 - base * CAST(factor AS DOUBLE)) AS BIGINT)", "CAST(rint(greatest(0, 5368709120 - base * CAST(factor AS DOUBLE))) AS BIGINT)"), SCENARIOS)
both("top_files", WITH + """
, r AS (SELECT id, category, size, row_number() OVER (PARTITION BY category ORDER BY size DESC, id) AS rank FROM typed)
SELECT id, category, size, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")

# -- differential synchronisation ---------------------------------------------------------
SNAPS = f"WITH files AS ({FILES}), old AS ({snapshot('old')}), cur AS ({snapshot('new')})"
ACTIONS = SNAPS + f""", actions AS (SELECT coalesce(c.id, o.id) AS id, CASE WHEN c.id IS NULL THEN 'removed'
  WHEN NOT (c.{SUPPORTED}) THEN 'unsupported' WHEN o.id IS NULL THEN 'new' WHEN o.modified <> c.modified THEN 'updated' ELSE 'skip' END AS action
  FROM cur c FULL OUTER JOIN old o ON o.id = c.id)"""
both("sync_actions", ACTIONS + " SELECT id, action FROM actions")
both("sync_counters", ACTIONS + """
SELECT count(*) AS listed, count(CASE WHEN action = 'new' THEN 1 END) AS added, count(CASE WHEN action = 'updated' THEN 1 END) AS updated,
  count(CASE WHEN action = 'skip' THEN 1 END) AS skipped, count(CASE WHEN action = 'removed' THEN 1 END) AS removed,
  count(CASE WHEN action = 'unsupported' THEN 1 END) AS unsupported FROM actions""")
STORES = f"""WITH chunks AS ({CHUNKS}), stored AS (SELECT document_id, chunk_index, vec_id % 3 AS content FROM chunks WHERE vec_id % 11 <> 0),
expected AS (SELECT document_id, chunk_index, CASE WHEN vec_id % 13 = 0 THEN 9 ELSE vec_id % 3 END AS content FROM chunks WHERE vec_id % 7 <> 0)"""
both("checkpoint_reuse", STORES + " SELECT e.document_id, e.chunk_index FROM expected e JOIN stored s ON s.document_id = e.document_id AND s.chunk_index = e.chunk_index AND s.content = e.content")
both("missing_chunks", STORES + " SELECT e.document_id, e.chunk_index FROM expected e LEFT ANTI JOIN stored s ON s.document_id = e.document_id AND s.chunk_index = e.chunk_index AND s.content = e.content",
     STORES + " SELECT e.document_id, e.chunk_index FROM expected e ANTI JOIN stored s ON s.document_id = e.document_id AND s.chunk_index = e.chunk_index AND s.content = e.content")
both("stale_chunks", STORES + " SELECT document_id, chunk_index FROM stored EXCEPT SELECT document_id, chunk_index FROM expected")
both("upsert_merge", STORES + " SELECT * FROM expected UNION ALL SELECT s.* FROM stored s WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE e.document_id = s.document_id AND e.chunk_index = s.chunk_index)")
both("delete_document", STORES + " SELECT * FROM stored WHERE document_id <> 'd3'")
both("meta_upsert", SNAPS + """
SELECT coalesce(c.id, o.id) AS id, coalesce(c.modified, o.modified) AS modified, c.id IS NOT NULL AS is_active FROM old o FULL OUTER JOIN cur c ON c.id = o.id""")
both("state_update", SNAPS + " SELECT o.id, CASE WHEN c.id IS NULL THEN false ELSE true END AS is_active, CASE WHEN c.modified = o.modified THEN true ELSE false END AS is_indexed FROM old o LEFT JOIN cur c ON c.id = o.id")
both("location_enrich", WITH + ", hits AS (SELECT 'f' || lpad(CAST(doc_id AS STRING), 7, '0') AS id FROM {documents}) SELECT h.id, NULLIF(f.parent, '') AS folder FROM hits h LEFT JOIN files f ON f.id = h.id")
both("migration_split", WITH + " SELECT count(*) AS candidates, count(CASE WHEN doc_id % 3 = 0 THEN 1 END) AS same_store, count(CASE WHEN doc_id % 3 <> 0 AND size = 0 THEN 1 END) AS empty FROM files WHERE " + SUPPORTED)

# -- logs and feedback --------------------------------------------------------------------
both("search_log_daily", """
SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'chat' END AS source, count(*) AS searches,
  count(DISTINCT user_id) AS users FROM {events} WHERE event_type = 'view' GROUP BY 1, 2""")
FEEDBACK = """WITH fb AS (SELECT event_id, user_id, event_id - event_id % 10 AS log_id, 1 + event_id % 25 AS rank, value AS score,
  CASE event_type WHEN 'click' THEN 'positive' ELSE 'negative' END AS feedback FROM {events} WHERE event_type IN ('click', 'error'))"""
both("feedback_valid", FEEDBACK + " SELECT event_id, feedback FROM fb WHERE rank BETWEEN 1 AND 20 AND score IS NOT NULL")
both("feedback_unique", FEEDBACK + " SELECT user_id, log_id, min(event_id) AS event_id, count(*) AS n FROM fb GROUP BY user_id, log_id")
both("feedback_owned", FEEDBACK + ", logs AS (SELECT event_id AS log_id, user_id FROM {events}) SELECT event_id FROM fb WHERE EXISTS (SELECT 1 FROM logs l WHERE l.log_id = fb.log_id AND l.user_id = fb.user_id)")
both("rate_window_60s", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS requests FROM {events}")
both("allow_list", "SELECT c_custkey FROM {customer} WHERE lower(c_name) IN (SELECT lower(c_name) FROM {customer} WHERE c_custkey % 10 = 0)")

# -- text and formats ---------------------------------------------------------------------
both("token_estimate", "SELECT doc_id, CAST(octet_length(text) + 16 AS BIGINT) AS tokens FROM {documents}", "SELECT doc_id, CAST(strlen(text) + 16 AS BIGINT) AS tokens FROM documents")
both("doc_format", "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%brass' THEN 'PDF' WHEN lower(p_name) LIKE '%a%' THEN 'DOC' ELSE 'FILE' END AS format FROM {part}")
both("score_normalize", "SELECT event_id, round(CASE WHEN value IS NULL THEN 0.0E0 ELSE least(1.0E0, greatest(0.0E0, value / 100 / (2.0E0 / 61))) END, 6) AS score FROM {events}")
both("descriptor_parse", "WITH d AS (SELECT n_nationkey AS k, 'provider=' || n_name || ';dim=' || CAST(64 + n_regionkey AS STRING) AS s FROM {nation}) SELECT k, str_to_map(s, ';', '=')['provider'] AS provider, CAST(str_to_map(s, ';', '=')['dim'] AS INT) AS dim FROM d",
     "WITH d AS (SELECT n_nationkey AS k, 'provider=' || n_name || ';dim=' || CAST(64 + n_regionkey AS STRING) AS s FROM nation) SELECT k, regexp_extract(s, 'provider=([^;]*)', 1) AS provider, CAST(regexp_extract(s, 'dim=([0-9]+)', 1) AS INT) AS dim FROM d")
both("search_text", WITH + " SELECT id, concat_ws(chr(10), NULLIF(name, ''), NULLIF(parent, 'folder0'), NULLIF(text, '')) AS search_text FROM files")
PARAGRAPH = "(?s)<p(?:\\s[^>]*)?>(.*?)</p>"
both("xml_text_values", "SELECT page_id, array_join(transform(regexp_extract_all(html, '" + PARAGRAPH.replace("\\", "\\\\") + "', 1), x -> regexp_replace(x, '<[^>]*>', '')), '|') AS paragraphs FROM {pages}",
     f"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '{PARAGRAPH}', 1), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')), '|') AS paragraphs FROM pages")
both("direct_messages", "SELECT conv_id, turn, text FROM {conversations} WHERE role = 'user' AND text IS NOT NULL AND text <> ''")
both("slide_fold", """
SELECT conv_id, CAST(count(*) AS BIGINT) AS shapes, max(CASE WHEN role = 'system' THEN text END) AS title,
  array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), chr(10)) AS text FROM {conversations} GROUP BY conv_id""",
     "SELECT conv_id, count(*) AS shapes, max(CASE WHEN role = 'system' THEN text END) AS title, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
