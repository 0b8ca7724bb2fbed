"""What the training-data operators share: tables, spilled intermediates, bounded filters."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one step of a Python operator holds at once.
ROWS_AT_ONCE = 500
#: 64-bit words of a membership bitmap: a quarter of the members, from 1 to 16 MiB.
LEAST_BITMAP, MOST_BITMAP = 1 << 17, 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table below ``sf_dir``; the path may be any URI that Spark reads."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def spill(df: DataFrame, name: str, grouped: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that
    survives the loss of executors. ``grouped``: rows of a row group at most, where rows are large."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.row.count.limit", grouped) if grouped else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where a column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        own = f"{name}_"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out.append(own)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand Python workers at most ``rows`` rows at once: long texts add up in both processes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def _trim() -> None:
    """Give freed memory back to the system: an idle worker's memory is the executor's too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with its memory given back at the end of each task."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return trimmed


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(array: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return [x or "" for x in array.to_pylist()]


def numbers(array: pa.Array) -> np.ndarray:
    return array.fill_null(0).to_numpy(zero_copy_only=False)


def remainder(ids: pa.Array, modulus: int) -> np.ndarray:
    """crc32(id as text) mod ``modulus``; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % modulus for x in ids.to_pylist()], dtype=np.int64)


def crc_remainder(col: Column | str, modulus: int) -> Column:
    """The same as ``remainder``, as an expression."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bitmap(df: DataFrame, key: str) -> np.ndarray:
    """A bitmap of the long column ``key`` (a hash) of a stored table. Its size follows the number
    of members up to a fixed one, so it may be sent to every task; what it lets pass by chance only
    costs time, since every user joins exactly afterwards."""
    words = min(MOST_BITMAP, max(LEAST_BITMAP, 1 << (df.count() // 4).bit_length()))
    word = F.pmod(F.col(key), F.lit(words))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(F.col(key), 40), F.lit(64)).cast("int"))
    out = np.zeros(words, dtype=np.uint64)
    rows = df.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 ``keys`` may be members."""
    keys = keys.astype(np.int64)
    shift = ((keys >> 40) % 64).astype(np.uint64)
    return (bits[keys % len(bits)] >> shift) & np.uint64(1) == 1


def pack(array: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)
