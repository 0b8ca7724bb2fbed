"""Reports of an analysis or an evaluation: lines, JSON and tables of cells."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.expressions import csv_value

# The cells of a file in a report.
CELLS = (
    "drive_file_id", "name", "mime_type", "category", "parent_folder_id", "status", "duplicate", "duplicate_of_drive_file_id", "source_file_bytes", "page_count", "slide_count",
    "extracted_characters", "extracted_bytes", "chunk_count", "chunk_text_characters", "chunk_text_payload_bytes", "metadata_payload_bytes", "drive_error_reason", "error",
)


def csv_line(files: DataFrame) -> Column:
    """The cells of a file in one line; columns that ``files`` lacks are empty."""
    return F.concat_ws(",", *[csv_value(F.col(c)) if c in files.columns else F.lit("") for c in CELLS])


def stamp(at: datetime) -> str:
    """The time in a report's name."""
    return at.strftime("%Y%m%d-%H%M%S")


def write_analysis(files: DataFrame, summary: DataFrame, folder: str, at: datetime) -> tuple[str, str]:
    """Write the report of an analysis below ``folder``: the ``summary`` rows as JSON and a line for each
    file, the cells' names first. Both are folders of parts, each written by its own task, whose
    parts in order make the file. The two paths."""
    spark, base = files.sparkSession, folder.rstrip("/")
    json_path, csv_path = f"{base}/drive-analysis-{stamp(at)}.json", f"{base}/drive-analysis-files-{stamp(at)}.csv"
    summary.write.mode("overwrite").option("ignoreNullFields", "false").json(json_path)
    names = spark.createDataFrame([(",".join(CELLS),)], "value string").coalesce(1)
    names.unionByName(files.select(csv_line(files).alias("value"))).write.mode("overwrite").text(csv_path)
    return json_path, csv_path


def console(title: str, totals: Mapping[str, object], formats: Iterable[Mapping[str, object]] = ()) -> str:
    """A report to be read: the totals, then a table of the formats; numbers with separators."""

    def shown(value: object) -> str:
        return "n/a" if value is None else f"{value:,}" if isinstance(value, int) else f"{value:,.2f}" if isinstance(value, float) else str(value)

    lines = [title, "=" * len(title)]
    width = max((len(k) for k in totals), default=0)
    lines += [f"{k:<{width}}  {shown(v):>14}" for k, v in totals.items()]
    rows = [{k: shown(v) for k, v in row.items()} for row in formats]
    if rows:
        widths = {k: max(len(k), *(len(r[k]) for r in rows)) for k in rows[0]}
        lines += ["", "  ".join(f"{k:<{w}}" for k, w in widths.items()).rstrip()]
        lines += ["  ".join(f"{r[k]:<{w}}" for k, w in widths.items()).rstrip() for r in rows]
    return "\n".join(lines)


def write_evaluation(metrics: DataFrame, summary: DataFrame, failures: DataFrame, identity: Mapping[str, str], folder: str) -> str:
    """Write a run's report below ``folder``: ``run`` (identity and summary, one row), ``cases`` and
    ``failures``, as JSON."""
    base = folder.rstrip("/")
    summary.select(*[F.lit(v).alias(k) for k, v in identity.items()], F.struct(*summary.columns).alias("summary")).write.mode("overwrite").json(f"{base}/run")
    metrics.write.mode("overwrite").json(f"{base}/cases")
    failures.write.mode("overwrite").json(f"{base}/failures")
    return base
