"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown breadth first on binned features (logistic loss, second-order gains)
and flattened into arrays; a batch of texts walks all trees at once with numpy.

Training reads labels of at most ``MOST_LABELLED`` documents (those with the least hash of
their id); everything is scored. An empty or null text has statistics of zeros and gets a
score like any other. Without labelled rows, or with one class only, every score is the
share of label 1 (0.5 without rows). A document with several labels counts as 1 if at
least half of them are. Repeated rows each get a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_remainder, lean, remainder, slices, table, texts

MOST_LABELLED = 20_000
BINS, DEPTH, TREES, RATE, L2 = 32, 4, 60, 0.15, 1.0
THRESHOLD = 0.3


def statistics(text: str) -> list[float]:
    """Twenty-two numbers that describe a text."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    n = max(len(raw), 1)
    by = np.bincount(raw, minlength=256)
    lower, upper, digits = by[97:123].sum(), by[65:91].sum(), by[48:58].sum()
    words, lines = text.split(), text.split("\n")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, np.int64)
    line_lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    distinct = set(words)
    capital = sum(map(str.isupper, words))
    w = max(len(words), 1)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean(), lengths.max(), lengths.std(),
        lower / n, upper / n, digits / n, by[128:].sum() / n, by[32] / n,
        (by[46] + by[44]) / n, by[33] / n, (by[35] + by[36] + by[37] + by[38] + by[42]) / n, by[124] / n, (by[47] + by[58] + by[64] + by[95]) / n,
        len(distinct) / w, capital / w, np.count_nonzero(lengths <= 3) / w,
        np.log1p(len(lines)), line_lengths.mean(), len(set(lines)) / len(lines), by[46] / w,
    ]


def feature_matrix(rows: list[str]) -> np.ndarray:
    return np.array([statistics(x) for x in rows], dtype=np.float64).reshape(len(rows), -1)


@dataclass
class Trees:
    """All trees in flat arrays: node i of tree t has children 2i+1 and 2i+2; a leaf passes
    every row to its left child, down to the last level, which holds the values."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    columns = x.shape[1]
    cuts = np.quantile(x, np.arange(1, BINS) / BINS, axis=0, method="lower").T  # columns x bins-1
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(columns)], axis=1)
    base = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            slot = ((node - first)[:, None] * columns + np.arange(columns)) * BINS + binned
            shape = (width, columns, BINS)
            gs = np.bincount(slot.ravel(), np.repeat(g, columns), width * columns * BINS).reshape(shape).cumsum(2)
            hs = np.bincount(slot.ravel(), np.repeat(h, columns), width * columns * BINS).reshape(shape).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            gain = np.where((hs > 1.0) & (ht - hs > 1.0), gain, -1.0)[:, :, :-1].reshape(width, -1)
            best = gain.argmax(1)
            good = gain[np.arange(width), best] > 1e-6
            feature[first : first + width] = np.where(good, best // (BINS - 1), 0)
            cut[first : first + width] = np.where(good, cuts[best // (BINS - 1), best % (BINS - 1)], np.inf)
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        margin += value[leaf]
        trees.append((feature, cut, value))
    return Trees(base, *(np.stack(x) for x in zip(*trees, strict=True)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_LABELLED) -> Trees:
    """Trees fitted to at most ``most`` labelled documents; ids and statistics of those
    reach the driver."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas().sort_values("doc_id")
    ids, y = chosen["doc_id"].to_numpy(dtype=np.int64), chosen["y"].to_numpy(dtype=np.float64)
    if not len(ids):
        return fit(np.zeros((0, 1)), y)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = pa.array(np.flatnonzero(ids[np.minimum(np.searchsorted(ids, own), len(ids) - 1)] == own))
            if len(keep):
                batch = batch.take(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(feature_matrix(texts(batch.column(1)))), pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null").mapInArrow(lean(measure), "doc_id long, x array<double>")
    found = rows.groupBy("doc_id").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    if found.empty:
        return fit(np.zeros((0, 1)), np.zeros(0))
    return fit(np.stack(found["x"].to_list()), y[np.searchsorted(ids, found["doc_id"].to_numpy(dtype=np.int64))])


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trees = train(docs, labels.filter(crc_remainder("doc_id", 5) != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = trees.score(feature_matrix(texts(batch.column(1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(remainder(batch.column(0), 5) == 0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")
