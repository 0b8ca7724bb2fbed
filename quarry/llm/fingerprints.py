"""Document fingerprints: a canonical exact digest.

Canonical form: Unicode NFKC, case folding, NFKC again, every run of white space one
blank, ends trimmed. The fingerprint is the 128-bit xxhash of its UTF-8 bytes. Documents
with equal fingerprints are compared byte by byte: if two canonical texts ever shared a
digest, the later ones (in byte order) get a numbered suffix.

Null text is the empty text and has a fingerprint like any other. Null ids sort last.
Repeated rows stay, each with its own result; very long texts are taken whole, a slice of rows at
a time; an empty table gives an empty result.
Columns beyond the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import bitmap, in_bitmap, lean, partitions, slices, spill, texts

#: Id ranges per shuffle partition when rows are paired with their successors, at least, and the
#: rows of a range beyond which there are more.
RANGES_PER_PARTITION, ROWS_PER_RANGE = 8, 20_000
_LOWEST = -(1 << 63)


def canonical(text: str | None) -> str:
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def digest(canonical_text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical_text.encode())


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next_text): the next document in descending id order, after the last one
    the first. Rows with one id follow each other in text order.

    The ids are cut into ranges by their quantiles; each range is one window, and the
    first row of a range is also given to the range above it, so that no task sees more
    than its range and the texts are shuffled once."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.coalesce("id", F.lit(_LOWEST))
    tasks = max(partitions(spark), -(-rows.count() // (RANGES_PER_PARTITION * ROWS_PER_RANGE)))
    ranges = RANGES_PER_PARTITION * tasks
    cuts = np.unique(rows.select(key.cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.25 / ranges))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(dtype=np.float64), side="right").astype(np.int32))

    keyed = rows.withColumn("key", key).withColumn("part", range_of(F.col("key")))
    tops = keyed.groupBy("part").agg(F.max("key").alias("top")).collect()  # a row for each range
    tops = sorted((r["part"], r["top"]) for r in tops)
    above = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    names, parts = np.array(sorted(above), dtype=np.int64), np.array([above[k] for k in sorted(above)], dtype=np.int32)

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series, own: pd.Series) -> pd.Series:
        found = np.searchsorted(names, keys.to_numpy(dtype=np.int64))
        found = np.minimum(found, max(len(names) - 1, 0))
        hit = names[found] == keys.to_numpy() if len(names) else np.zeros(len(keys), bool)
        return pd.Series([[a, int(parts[i])] if h else [a] for a, i, h in zip(own.tolist(), found, hit, strict=True)])

    dealt = keyed.select("id", "text", "key", F.posexplode(places("key", "part")).alias("guest", "place")).repartition(tasks, "place")
    order = Window.partitionBy("place").orderBy("guest", F.desc("key"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).filter("guest = 0").select("id", "text", "next_text")


def edit(text: str, following: str) -> str:
    """The last half of ``text`` replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: list[tuple] = []
        for doc_id, text, following in zip(batch.column(0).to_pylist(), texts(batch.column(1)), texts(batch.column(2)), strict=True):
            edited = edit(text, following)
            own, changed, after = canonical(text), canonical(edited), canonical(following)
            sha = hashlib.sha256(edited.encode()).hexdigest()
            out.append((doc_id, len(text), sha, digest(own), digest(changed), float(own == changed), float(own == after)))
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and the likeness of each pair: 1 if
    digests and canonical bytes agree, else 0."""
    return with_successor(docs, id_col, text_col).mapInArrow(lean(_compare), _PAIR_SCHEMA)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row, before byte comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [digest(canonical(x)) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(lean(run), "doc_id long, fingerprint string")


def exact_groups(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``prints`` with ``group_id`` (least id with the same canonical text) and ``group_size``.

    Only digests that occur twice send their texts anywhere, each distinct text once from
    each task. ``prints`` should be stored: it is read several times."""
    buckets = prints.groupBy("fingerprint").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("group_id"))
    shared = spill(buckets.filter("group_size > 1"), "buckets")
    bits = bitmap(shared.select(F.xxhash64("fingerprint").alias("k")), "k")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            forms = [canonical(x) for x in texts(batch.column(1))]
            prints_ = [digest(x) for x in forms]
            keys = np.array([_spark_hash(x) for x in prints_], dtype=np.int64)
            keep = np.flatnonzero(in_bitmap(bits, keys))
            ids = batch.column(0).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, pa.array([prints_[i] for i in keep], pa.string()), pa.array([forms[i] for i in keep], pa.string())], names=["doc_id", "fingerprint", "form"])

    forms = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(lean(candidates), "doc_id long, fingerprint string, form string")
    distinct = forms.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    clashing = spill(distinct.withColumn("n", F.lit(1)).groupBy("fingerprint").agg(F.sum("n").alias("n")).filter("n > 1").select("fingerprint"), "clashes")
    grouped = prints.join(shared, "fingerprint", "left").withColumn("group_id", F.coalesce("group_id", "doc_id")).withColumn("group_size", F.coalesce("group_size", F.lit(1)))
    if clashing.isEmpty():
        return grouped
    return _separated(grouped, forms.join(clashing, "fingerprint", "left_semi"))


def _separated(grouped: DataFrame, clashing: DataFrame) -> DataFrame:
    """Different canonical texts with one digest: a group and a suffix for each."""
    order = Window.partitionBy("fingerprint").orderBy("form")
    classes = clashing.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("own_id"), F.count("*").alias("own_size")).withColumn("variant", F.row_number().over(order) - 1)
    own = clashing.join(classes, ["fingerprint", "form"]).select("doc_id", "own_id", "own_size", "variant").distinct()
    suffix = F.when(F.col("variant") > 0, F.concat(F.lit("-"), F.col("variant").cast("string"))).otherwise("")
    joined = grouped.join(own, "doc_id", "left")
    changed = joined.withColumn("fingerprint", F.concat("fingerprint", F.coalesce(suffix, F.lit(""))))
    return changed.withColumn("group_id", F.coalesce("own_id", "group_id")).withColumn("group_size", F.coalesce("own_size", "group_size")).drop("own_id", "own_size", "variant")


def _spark_hash(text: str) -> int:
    """Spark's xxhash64 of one string (seed 42), as a signed number."""
    value = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return value - (1 << 64) if value >= 1 << 63 else value


def op1_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document and its edited text; further columns: the group of equal texts."""
    from quarry.llm.common import table

    docs = table(spark, sf_dir, "documents")
    prints = spill(compare_with_edits(docs), "fingerprints")
    columns = [*prints.columns, "group_id", "group_size"]
    return exact_groups(docs, prints).select(*columns)
