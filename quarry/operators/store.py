"""What a chunk store does to its rows: upserts, sweeps and deletes as joins, vectors that are used
again, and the identity that a store and its user must share. ``committed.Store`` applies them to
the buckets that a change touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of one batch of a checkpoint.
CHECKPOINT = 20


class IncompatibleStore(ValueError):
    """The store was written with other vectors or another provider."""


@dataclass(frozen=True)
class Identity:
    """What must agree between a store and its user."""

    provider: str
    dimensions: int

    def descriptor(self) -> str:
        return f"provider={self.provider};dimensions={self.dimensions}"


def checked(chunks: DataFrame, dimensions: int) -> DataFrame:
    """``chunks``; an embedding of another length is an error when the row is read."""
    ok = F.size("embedding") == dimensions
    return chunks.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit("embedding of another length")).cast(chunks.schema["embedding"].dataType)))


def latest(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """A row for each key: the last by ``order``. Without one, a key that is given twice is an error."""
    whole = F.struct(*rows.columns)
    if order:
        return rows.groupBy(key).agg(F.max_by(whole, F.col(order)).alias("row_")).select("row_.*")
    counted = rows.groupBy(key).agg(F.first(whole).alias("row_"), F.count("*").alias("n_"))
    once = F.when(F.col("n_") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("a key is given twice: "), F.col(key).cast("string"))).cast(rows.schema[key].dataType))
    return counted.select(*[once.alias(c) if c == key else F.col(f"row_.{c}").alias(c) for c in rows.columns])


def once(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, which are read once for their keys alone: one that is given twice is an error."""
    twice = rows.groupBy(key).count().filter("count > 1").first()
    if twice:
        raise ValueError(f"a key is given twice: {twice[key]}")
    return rows


def upserted(base: DataFrame, updates: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """``base`` with the rows of ``updates`` in place of those with their keys; of updates with one
    key the last by ``order``."""
    new = latest(updates, key, order).select(*base.columns)
    return base.join(new.select(key), key, "left_anti").select(*base.columns).unionByName(new)


def swept(base: DataFrame, expected: DataFrame, document: str = "document_id", key: str = "id") -> DataFrame:
    """``base`` without chunks that the documents in ``expected`` no longer have."""
    touched = base.join(expected.select(document).distinct(), document, "left_semi")
    stale = touched.join(expected.select(key), key, "left_anti").select(key)
    return base.join(stale, key, "left_anti").select(*base.columns)


def without(base: DataFrame, documents: DataFrame, document: str = "document_id") -> DataFrame:
    """``base`` without the chunks of ``documents``."""
    return base.join(documents.select(document).distinct(), document, "left_anti").select(*base.columns)


def reusable(expected: DataFrame, stored: DataFrame, dimensions: int) -> DataFrame:
    """Expected chunks with the stored vector of the same id, document, source time and content. Contents are
    compared by their SHA-256, so that they do not travel unless the result is asked for them."""
    keys = [c for c in ("id", "document_id") if c in expected.columns and c in stored.columns]
    s = stored.filter(F.size("embedding") == dimensions).select(*keys, F.sha2("content", 256).alias("c_"), F.col("source_modified_time").alias("t_"), "embedding")
    found = expected.withColumn("d_", F.sha2("content", 256)).join(s, keys).filter("d_ = c_ AND source_modified_time = t_")
    return found.select(*expected.columns, "embedding")
