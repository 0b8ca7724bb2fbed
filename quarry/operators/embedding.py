"""Hashed text vectors, and batches for providers that limit what one request holds."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

# FNV-1a, and the weights of words, pairs of words and runs of 2 and 3 characters.
OFFSET, PRIME, BITS32 = 2166136261, 16777619, 0xFFFFFFFF
WORD, PAIR, RUNS = 2.0, 1.5, ((2, 0.55), (3, 0.35))
#: Items and estimated tokens of one request.
ITEMS, TOKENS = 1000, 1_000_000
_WORDS = re.compile(r"[^\W_]+")


def _fnv(text: str, start: int = OFFSET) -> int:
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist()
    for unit in units:
        start = ((start ^ unit) * PRIME) & BITS32
    return start


@lru_cache(1 << 17)
def _hashes(feature: str) -> tuple[int, float]:
    own = _fnv(feature)
    return own, 1.0 if _fnv(":sign", own) % 2 == 0 else -1.0


def features(text: str) -> dict[str, tuple[int, float]]:
    """Each feature of a text with its count and weight."""
    plain = unicodedata.normalize("NFKC", text).lower().strip()
    found = _WORDS.findall(plain)
    out = {f"word:{w}": (n, WORD) for w, n in Counter(found).items()}
    out |= {f"pair:{a}_{b}": (n, PAIR) for (a, b), n in Counter(zip(found, found[1:], strict=False)).items()}
    flat = re.sub(r"\s+", " ", plain)
    for size, weight in RUNS:
        runs = Counter(flat[k : k + size] for k in range(len(flat) - size + 1))
        out |= {f"char-{size}:{r}": (n, weight) for r, n in runs.items()}
    return out


def hashed(text: str, dimensions: int = 384) -> np.ndarray:
    """A unit vector of the text's features; a text without any is the zero vector."""
    out = np.zeros(dimensions)
    for feature, (count, weight) in features(text).items():
        own, sign = _hashes(feature)
        out[own % dimensions] += sign * weight * (1 + math.log(count))
    length = math.sqrt(float(out @ out))
    return out / length if length else out


def embed(texts: DataFrame, column: str = "text", dimensions: int = 384) -> DataFrame:
    """``texts`` with a column embedding. Each row is embedded where it lies: no shuffle; null
    is the empty text."""
    if dimensions < 8:
        raise ValueError("a vector has eight dimensions at least")

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            codes, distinct = pd.factorize(batch.fillna(""))
            own = [hashed(t, dimensions) for t in distinct]  # copies of a text are embedded once
            yield pd.Series([own[c] for c in codes])

    return texts.withColumn("embedding", vectors(F.col(column)))


def embed_sparse(texts: DataFrame, column: str = "text", dimensions: int = 384, least: float = 0.0) -> DataFrame:
    """``texts`` with a column embedding of (bucket, value) for the numbers beyond ``least``: a short text fills
    few of its dimensions, and no others leave the workers."""
    if dimensions < 8:
        raise ValueError("a vector has eight dimensions at least")
    names = [*texts.columns, "embedding"]
    schema = StructType([*texts.schema.fields, StructField("embedding", ArrayType(StructType([StructField("bucket", IntegerType()), StructField("value", DoubleType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column(names.index(column)).fill_null("").dictionary_encode()
            vectors = [hashed(t, dimensions) for t in told.dictionary.to_pylist()]
            filled = [np.flatnonzero(np.abs(v) > least) for v in vectors]
            ends = np.cumsum([0, *map(len, filled)])
            buckets = np.concatenate([np.empty(0, np.int64), *filled])
            values = np.concatenate([np.empty(0), *(v[at] for v, at in zip(vectors, filled, strict=True))])
            pairs = pa.StructArray.from_arrays([pa.array(buckets, pa.int32()), pa.array(values)], names=["bucket", "value"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists.take(told.indices)], names=names)

    return texts.mapInArrow(run, schema)


def packed(rows: DataFrame, group: str, order: str, text: str, items: int = ITEMS, tokens: int = TOKENS) -> DataFrame:
    """``rows`` with a column batch, counted from 0 within each ``group``: as many rows in
    ``order`` as fit into ``items`` and ``tokens`` (UTF-8 bytes + 16 each). A text beyond
    ``tokens`` is an error. Rows are read as a sorted stream: no group is held in memory."""
    schema = StructType([*rows.schema.fields, StructField("batch", LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, held, size = None, 0, 0, 0
        for frame in frames:
            out = []
            for key, need in zip(frame[group].tolist(), frame["need_"].tolist(), strict=True):
                if need > tokens:
                    raise ValueError(f"a text of {need} tokens is beyond the {tokens} of a batch")
                if at is None or key != at[0]:
                    at, batch, held, size = (key,), 0, 0, 0
                elif held >= items or size + need > tokens:
                    batch, held, size = batch + 1, 0, 0
                held, size = held + 1, size + need
                out.append(batch)
            yield frame.drop(columns="need_").assign(batch=out)

    sized = rows.withColumn("need_", F.coalesce(F.octet_length(text), F.lit(0)) + 16)
    return sized.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, schema)
