"""Deep analysis of a corpus: a status for every file, and summaries by format and as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.sync import SUPPORTED

# What the known reasons of a failed download make of a file.
FAILURES = {
    "cannotDownloadAbusiveFile": "skipped_abusive_file",
    "insufficientFilePermissions": "permission_error",
    "exportSizeLimitExceeded": "export_size_error",
    "fileNotDownloadable": "file_not_downloadable",
}
# Faults of the network after which a download is tried again.
NETWORK_FAULTS = ("ECONNRESET", "ETIMEDOUT", "EAI_AGAIN", "ENETUNREACH")


def failure_status(reason: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, reason), F.lit("extraction_failed"))


def may_retry(status: Column, code: Column) -> Column:
    return F.coalesce((status == 429) | (status >= 500), F.lit(False)) | F.coalesce(code.isin(*NETWORK_FAULTS), F.lit(False))


def statuses(files: DataFrame, pairs: DataFrame, sampled: DataFrame | None, analysed: DataFrame) -> DataFrame:
    """Every file (id, mime, ...) with status, duplicate_of and what ``analysed`` (id, status, ...)
    measured. A duplicate (pairs: id, kept_id) comes before an unsupported file, that before one
    outside ``sampled`` (id; null: all are in). A file that should have been analysed and was not
    is a failure."""
    measures = [c for c in analysed.columns if c not in ("id", "status")]
    joined = files.join(pairs.select("id", F.col("kept_id").alias("duplicate_of")), "id", "left")
    chosen = F.lit(True)
    if sampled is not None:
        joined = joined.join(sampled.select("id", F.lit(True).alias("chosen_")), "id", "left")
        chosen = F.coalesce("chosen_", F.lit(False))
    joined = joined.join(analysed.select("id", F.col("status").alias("found_"), *measures), "id", "left")
    status = (
        F.when(F.col("duplicate_of").isNotNull(), "duplicate_skipped")
        .when(~F.col("mime").isin(*SUPPORTED), "unsupported")
        .when(~chosen, "not_sampled")
        .otherwise(F.coalesce("found_", F.lit("extraction_failed")))
    )
    return joined.select(*files.columns, status.alias("status"), "duplicate_of", *measures)


def measured(chunks: DataFrame) -> DataFrame:
    """(id, chunk_count, chunk_text_characters, chunk_text_payload_bytes, metadata_payload_bytes) of
    files from their chunks (document_id, content, payload: the chunk as JSON)."""
    size = F.octet_length("content")
    return chunks.groupBy(F.col("document_id").alias("id")).agg(
        F.count("*").alias("chunk_count"), F.sum(F.length("content")).alias("chunk_text_characters"), F.sum(size).alias("chunk_text_payload_bytes"),
        F.sum(F.greatest(F.lit(0), F.octet_length("payload") - size)).alias("metadata_payload_bytes"))


def extracted_sizes(sections: Column) -> tuple[Column, Column]:
    """Characters and bytes of a list of sections."""

    def total(of: Callable[[Column], Column]) -> Column:
        return F.aggregate(sections, F.lit(0).cast("long"), lambda s, x: s + of(x["text"]))

    return total(F.length), total(F.octet_length)


_QUARTILES = (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))


def _metric(value: str, name: str) -> str:
    ranks = ", ".join(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY {value}) AS BIGINT) AS {name}_{label}" for label, p in _QUARTILES)
    return f"coalesce(sum({value}), 0) AS {name}_total, coalesce(avg({value}), 0.0D) AS {name}_average, min({value}) AS {name}_min, {ranks}, max({value}) AS {name}_max"


_EDGES = (10, 25, 50, 100, 250, 500)
_COUNTED = {
    "successfully_analyzed": "success", "extraction_failed": "extraction_failed", "skipped_abusive_files": "skipped_abusive_file", "permission_errors": "permission_error",
    "export_size_errors": "export_size_error", "file_not_downloadable_errors": "file_not_downloadable", "empty_documents": "empty_document"}


def by_format(files: DataFrame) -> DataFrame:
    """A row for each category of analysed files (category, status, page_count, slide_count, chunk_count,
    extracted_characters, extracted_bytes, chunk_text_characters, chunk_text_payload_bytes,
    metadata_payload_bytes, metadata_estimated_chunks). Projections are scaled, if any file is not
    sampled, from those that were read to all that are to be indexed. One aggregation."""
    histogram = [f"count_if(chunks > {low} AND chunks <= {high}) AS le{high}" for low, high in zip((-1, *_EDGES), _EDGES, strict=False)] + [f"count_if(chunks > {_EDGES[-1]}) AS more"]
    text = f"""
WITH m AS (SELECT *, status NOT IN ('unsupported', 'duplicate_skipped') AS target, status NOT IN ('unsupported', 'duplicate_skipped', 'not_sampled') AS chosen,
  status = 'success' AS ok, CASE WHEN status = 'success' THEN coalesce(chunk_count, 0) END AS chunks, CASE WHEN status = 'success' THEN page_count END AS pages,
  CASE WHEN status = 'success' THEN slide_count END AS slides FROM {{files}}),
s AS (SELECT bool_or(status = 'not_sampled') AS sampled FROM {{files}}),
a AS (SELECT category, count(*) AS total_files, count_if(target) AS index_target_files, count_if(chosen) AS selected_files,
  {", ".join(f"count_if(status = '{status}') AS {name}" for name, status in _COUNTED.items())},
  sum(if(ok, coalesce(extracted_characters, 0), 0)) AS total_extracted_characters, sum(if(ok, coalesce(extracted_bytes, 0), 0)) AS total_extracted_bytes,
  sum(if(ok, coalesce(chunk_text_characters, 0), 0)) AS total_chunk_text_characters, sum(if(ok, coalesce(chunk_text_payload_bytes, 0), 0)) AS text_bytes,
  sum(if(ok, coalesce(metadata_payload_bytes, 0), 0)) AS metadata_bytes, sum(if(chosen, coalesce(metadata_estimated_chunks, 0), 0)) AS metadata_estimated_chunks,
  {_metric('pages', 'pages')}, {_metric('slides', 'slides')}, {_metric('chunks', 'chunks')}, {", ".join(histogram)} FROM m GROUP BY category),
p AS (SELECT a.*, CASE WHEN sampled AND successfully_analyzed + empty_documents > 0 THEN index_target_files / (successfully_analyzed + empty_documents) ELSE 1.0D END AS scale FROM a CROSS JOIN s)
SELECT * EXCEPT (scale, text_bytes, metadata_bytes), coalesce(try_divide(total_extracted_characters, successfully_analyzed), 0.0D) AS average_characters_per_file,
  coalesce(try_divide(total_chunk_text_characters, chunks_total), 0.0D) AS average_characters_per_chunk, try_divide(total_extracted_characters, pages_total) AS average_characters_per_page,
  try_divide(total_extracted_characters, slides_total) AS average_characters_per_slide, coalesce(try_divide(metadata_estimated_chunks, selected_files), 0.0D) AS metadata_estimated_average,
  CAST(floor(chunks_total * scale + 0.5D) AS BIGINT) AS projected_chunks, CAST(floor(text_bytes * scale + 0.5D) AS BIGINT) AS projected_text_bytes,
  CAST(floor(metadata_bytes * scale + 0.5D) AS BIGINT) AS projected_metadata_bytes FROM p"""
    return files.sparkSession.sql(text, files=files)


def corpus(files: DataFrame, duplicate_pairs: int, requested: int | None = None) -> DataFrame:
    """One row over all files (category, status, chunk_count): their numbers by status, the chunks
    measured and, from ``by_format``, those projected."""
    skipped = ("unsupported", "duplicate_skipped")
    status = F.col("status")
    whole = files.agg(
        F.count("*").alias("total_files"), F.count_if(F.col("category") == "PDF").alias("pdf_files"), F.count_if(F.col("category") == "PPTX").alias("pptx_files"),
        F.count_if(status != "unsupported").alias("supported_files"), F.lit(duplicate_pairs).cast("long").alias("duplicate_pairs"),
        F.count_if((F.col("category") == "PDF") & (status == "duplicate_skipped")).alias("skipped_duplicate_pdfs"), F.count_if(~status.isin(*skipped)).alias("final_index_target_files"),
        F.count_if(status == "unsupported").alias("unsupported_files"), F.count_if(~status.isin(*skipped, "not_sampled")).alias("selected_for_analysis"),
        *[F.count_if(status == value).alias(name) for name, value in _COUNTED.items()],
        F.count_if(status == "duplicate_skipped").alias("duplicate_skipped"), F.count_if(status == "not_sampled").alias("not_sampled"),
        F.coalesce(F.bool_or(status == "not_sampled"), F.lit(False)).alias("is_sampled"), F.lit(requested).cast("long").alias("requested_sample_size"),
        F.coalesce(F.sum(F.when(status == "success", F.col("chunk_count"))), F.lit(0)).alias("measured_chunks"))
    projected = by_format(files).agg(F.coalesce(F.sum("projected_chunks"), F.lit(0)).alias("projected_total_chunks"))
    return whole.crossJoin(projected)  # a row each


def storage(vectors: int, text_bytes: int, metadata_bytes: int, dimensions: int, capacity: int) -> list[dict]:
    """What the vectors, texts and metadata take, and how they fit at 1, 1.5, 2 and 3 times their
    size. The risk follows from the use at three times."""
    per = 4 * dimensions
    parts = {"vector_bytes": vectors * per, "text_bytes": text_bytes, "metadata_bytes": metadata_bytes}
    base = sum(parts.values())
    use = 300 * base / capacity
    # The names of the risks and where they begin.
    risk = "NO DATA" if not base else "LOW RISK" if use < 25 else "MODERATE RISK" if use < 60 else "HIGH RISK"
    each = base / vectors if vectors else 0
    return [
        parts | {"factor": f, "bytes": base * f, "percent": 100 * base * f / capacity, "remaining": max(0, capacity - base * f), "most_chunks": int(capacity / (each * f)) if each else None, "risk": risk}
        for f in (1.0, 1.5, 2.0, 3.0)
    ]


#: What the rankings go by, and the category each is limited to.
RANKINGS = (("chunk_count", None), ("extracted_bytes", None), ("page_count", "PDF"), ("slide_count", "PPTX"))


def top_files(files: DataFrame, most: int = 10) -> DataFrame:
    """(ranking, rank, id, value) of the largest files that were analysed, ties by id: a top-k for
    each ranking, no window."""
    out = None
    for measure, category in RANKINGS:
        kept = files.filter((F.col("status") == "success") & F.col(measure).isNotNull())
        if category:
            kept = kept.filter(F.col("category") == category)
        best = kept.orderBy(F.desc(measure), "id").limit(most).select("id", F.col(measure).cast("long").alias("value"))
        rows = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("v"), "id"))).alias("best"))
        rows = rows.select(F.lit(measure).alias("ranking"), F.posexplode("best").alias("pos", "b")).select("ranking", (F.col("pos") + 1).alias("rank"), "b.id", (-F.col("b.v")).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out
