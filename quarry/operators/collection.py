"""The schema of a collection of chunks, and whether one that exists may be used."""

from __future__ import annotations

import warnings
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.operators.store import IncompatibleStore

# Fields of a collection, their types and whether they may be null.
FIELDS = (
    ("id", "string", False), ("documentId", "string", False), ("sourceModifiedTime", "string", True), ("driveFileId", "string", True), ("documentName", "string", False),
    ("mimeType", "string", True), ("chunkIndex", "long", False), ("content", "string", False), ("page", "long", True), ("slide", "long", True), ("sectionTitle", "string", True),
    ("url", "string", True),
)
VECTOR, SEARCH_TEXT = "embedding", "searchText"
# Keys of a collection's description.
PROVIDER_KEY, HYBRID_KEY = "embeddingProvider", "hybrid"
#: What a hybrid collection of ours records.
HYBRID_ID = "bm25-v1"


def schema(dimensions: int, hybrid: bool = False) -> T.StructType:
    """The fields of a collection; a hybrid one has the text that the posting lists are made of."""
    own = T.StructType()
    for name, kind, nullable in FIELDS:
        own.add(name, kind, nullable)
    own.add(VECTOR, T.ArrayType(T.FloatType(), False), False, {"dim": dimensions})
    return own.add(SEARCH_TEXT, "string", False) if hybrid else own


def described(description: str) -> dict[str, str]:
    pairs = (part.partition("=") for part in description.split(";") if "=" in part)
    return {key: unquote(value) for key, _, value in pairs}


def check(found: T.StructType, description: str, dimensions: int, provider: str | None = None, hybrid: bool = False) -> None:
    """Refuse a collection that lacks a field, has other vectors, another provider, or is not hybrid where
    that is wanted. One that records no provider is used with a warning."""
    lacking = [f.name for f in schema(dimensions, hybrid) if f.name not in found.names]
    if lacking:
        raise IncompatibleStore(f"no field {lacking[0]}")
    size = found[VECTOR].metadata.get("dim")
    if size != dimensions:
        raise IncompatibleStore(f"vectors of {size or 'unknown'} dimensions, not {dimensions}")
    recorded = described(description)
    if provider and not recorded.get(PROVIDER_KEY):
        warnings.warn("the collection records no provider: its vectors may be another model's", stacklevel=2)
    elif provider and recorded[PROVIDER_KEY] != provider:
        raise IncompatibleStore(f"vectors of {recorded[PROVIDER_KEY]}, not {provider}")
    if hybrid and recorded.get(HYBRID_KEY) != HYBRID_ID:
        raise IncompatibleStore(f"not a hybrid collection of {HYBRID_ID}")


def ensure(spark: SparkSession, path: str, description: str, dimensions: int, provider: str | None = None, hybrid: bool = False) -> DataFrame:
    """The collection at ``path``, made empty where there is none and checked where there is one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([(description,)], "value string").coalesce(1).write.text(f"{path}/description")
        spark.createDataFrame([], schema(dimensions, hybrid)).write.parquet(f"{path}/chunks")
    out = spark.read.parquet(f"{path}/chunks")
    check(out.schema, spark.read.text(f"{path}/description").first()[0], dimensions, provider, hybrid)
    return out


def alive(tables: dict[str, DataFrame], key: str = "id") -> dict[str, int]:
    """How many rows, 0 or 1, a read of one key of each table gave; a failed read raises."""
    return {name: len(t.select(key).limit(1).collect()) for name, t in tables.items()}
