"""Differential synchronisation of a file listing with what is indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.fixtures import DOCS, DOCX, PDF, PPTX, SLIDES

SUPPORTED = (PDF, PPTX, DOCX, SLIDES, DOCS)


def same_instant(a: Column, b: Column) -> Column:
    """Timestamps that mean one instant; texts that are none must be equal."""
    return F.coalesce(F.try_to_timestamp(a) == F.try_to_timestamp(b), a.eqNullSafe(b))


def duplicate_pairs(files: DataFrame) -> DataFrame:
    """(id, kept_id): PDFs with a PPTX of the same base name in a shared folder; columns id,
    base, mime, parents."""
    held = files.select("id", "base", "mime", F.explode(F.array_distinct("parents")).alias("parent"))
    pdf = held.filter(F.col("mime") == PDF).select("id", "base", "parent")
    pptx = held.filter(F.col("mime") == PPTX).groupBy("base", "parent").agg(F.min("id").alias("other"))  # one of a name and folder
    return pdf.join(pptx, ["base", "parent"]).groupBy("id").agg(F.min("other").alias("kept_id"))


def actions(listing: DataFrame, state: DataFrame, provider: str, store: str) -> DataFrame:
    """(id, action, kept_id) of every file: listing (id, base, mime, parents, modified) against
    state (id, modified, is_indexed, provider, store). One full outer join decides all."""
    pairs = duplicate_pairs(listing)
    old = state.select(F.col("id"), F.col("modified").alias("old_modified"), "is_indexed", "provider", "store", F.lit(True).alias("known"))
    joined = listing.withColumn("listed", F.lit(True)).join(old, "id", "full_outer").join(pairs, "id", "left")
    current = F.col("is_indexed") & same_instant(F.col("modified"), F.col("old_modified")) & (F.col("provider") == provider) & (F.col("store") == store)
    action = (
        F.when(F.col("listed").isNull(), "removed")
        .when(F.col("kept_id").isNotNull(), "duplicate")
        .when(~F.col("mime").isin(*SUPPORTED), "unsupported")
        .when(F.col("known").isNull(), "new")
        .when(F.coalesce(current, F.lit(False)), "skip")
        .otherwise("updated")
    )
    return joined.select("id", action.alias("action"), "kept_id")


def counters(acted: DataFrame) -> DataFrame:
    """One row: how many files each action has."""
    names = ("new", "updated", "skip", "duplicate", "unsupported", "removed")
    return acted.agg(F.count("*").alias("files"), *(F.count_if(F.col("action") == n).alias(n) for n in names))


#: Chunks of one request to embed and save.
CHECKPOINT = 20
# The failures that a source tells apart, with the counter of each; the first one is no failure of the run.
KNOWN_FAILURES = {
    "cannotDownloadAbusiveFile": "skipped_abusive_files",
    "insufficientFilePermissions": "permission_errors",
    "exportSizeLimitExceeded": "export_size_errors",
    "fileNotDownloadable": "file_not_downloadable_errors",
}


def run_files(listing: DataFrame, state: DataFrame, outcomes: DataFrame, provider: str, store: str, batch: int = CHECKPOINT) -> DataFrame:
    """What a run does with each file: ``actions``, then what came of those that are new or updated.

    ``listing`` has an ``ordinal`` besides what ``actions`` needs; ``outcomes`` (id, result, reused)
    says what reading a file gave: ok, empty, quota (embedding stops for the day), one of
    ``KNOWN_FAILURES``, or anything else for a failure; ``reused`` holds for each chunk in order whether
    its vector is stored. One file's failure touches no other; quota ends the run: what comes
    later in the listing is deferred. Chunks go where ``clears`` is true; an unknown failure keeps
    them. Batches without a missing chunk are not sent."""
    if not 1 <= batch <= 100:
        raise ValueError("a batch has 1 to 100 chunks")
    acted = actions(listing, state, provider, store).join(listing.select("id", "ordinal"), "id", "left")
    rows = acted.join(outcomes.select("id", "result", "reused"), "id", "left")
    todo = F.col("action").isin("new", "updated")
    rows = rows.withColumn("result", F.when(todo, F.coalesce("result", F.lit("missing"))))
    stop = rows.filter("result = 'quota'").agg(F.min("ordinal").alias("stop"))
    rows = rows.crossJoin(F.broadcast(stop))  # one row
    late = F.coalesce(F.col("ordinal") > F.col("stop"), F.lit(False)) & F.col("action").isin("new", "updated", "skip")
    result = F.when(~late, F.col("result"))
    flags = F.coalesce("reused", F.array().cast("array<boolean>"))
    starts = F.when(F.size(flags) > 0, F.sequence(F.lit(1), F.size(flags), F.lit(batch))).otherwise(F.array().cast("array<int>"))
    missing = F.filter(F.transform(starts, lambda at: F.size(F.filter(F.slice(flags, at, batch), lambda x: ~x))), lambda n: n > 0)
    sent = F.when(result == "ok", missing).when(result == "quota", F.slice(missing, 1, 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(sent, F.lit(0).cast("long"), lambda s, n: s + n)
    read = F.coalesce(result.isin("ok", "quota"), F.lit(False))
    clears = F.col("action").isin("duplicate", "removed") | F.coalesce(result.isin("empty", *KNOWN_FAILURES), F.lit(False))
    return rows.select(
        "id", "action", "kept_id", result.alias("result"), late.alias("late"),
        ((F.col("action") == "skip") | F.coalesce(result == "ok", F.lit(False))).alias("is_indexed"), clears.alias("clears"),
        F.when(read, F.size(F.filter(flags, lambda x: x))).otherwise(0).cast("long").alias("reused_chunks"),
        F.when(result == "ok", total).otherwise(0).cast("long").alias("embedded_chunks"), F.size(sent).cast("long").alias("batches"), total.alias("inputs"))


def run_counters(files: DataFrame) -> DataFrame:
    """The counters of a run over its ``run_files``, in one row."""
    action, result, late = F.col("action"), F.col("result"), F.col("late")
    todo = action.isin("new", "updated")

    def count(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    abusive, *others = KNOWN_FAILURES
    return files.agg(
        count((action == "new") & (result == "ok")).alias("new"), count((action == "updated") & (result == "ok")).alias("updated"),
        count((action == "skip") & ~late).alias("skipped"), count(action == "duplicate").alias("duplicates"),
        count(todo & ~late & ~result.isin("ok", "empty", abusive)).alias("failed"), count(action == "removed").alias("removed"), count(action == "unsupported").alias("unsupported"),
        count(result == abusive).alias(KNOWN_FAILURES[abusive]), count(result == "empty").alias("skipped_empty_documents"),
        *[count(result == reason).alias(KNOWN_FAILURES[reason]) for reason in others],
        F.coalesce(F.bool_or(result == "quota"), F.lit(False)).alias("embedding_quota_exhausted"), count(todo & (late | (result == "quota"))).alias("deferred"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("embedded_chunks", "embedded_chunks"), ("reused_chunks", "reused_chunks"), ("batches", "embedding_batch_attempts"), ("inputs", "embedding_input_attempts"))])
