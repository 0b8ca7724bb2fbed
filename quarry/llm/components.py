"""Connected components of an edge table, by labels that spread and jump."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, spill


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node it reaches over the edges a-b."""
    nodes, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = forest(np.concatenate((a, batch.column(0).to_numpy())), np.concatenate((b, batch.column(1).to_numpy())))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (long columns a, b) and the least node it
    reaches. Each task contracts its own edges, then those that share an end. What is left
    are trees (each edge from a lesser node a to b) in which, until all are stars, every node
    keeps its least parent, hands its other parents to that one, and jumps to its parent's
    parent; each step is a stored table."""
    part = edges.select("a", "b").mapInArrow(lean(_shrink), "a long, b long").filter("a <> b")
    tree = spill(part.repartition("b").mapInArrow(lean(_shrink), "a long, b long").distinct(), "edges")
    while True:
        parent = tree.groupBy("b").agg(F.min("a").alias("m"))
        above = parent.select(F.col("b").alias("m"), F.col("m").alias("top"))
        jumped = parent.join(above, "m", "left").select(F.coalesce("top", "m").alias("a"), "b", F.col("top").isNotNull().alias("moved"))
        handed = tree.join(parent, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"), F.lit(True).alias("moved"))
        after = spill(jumped.unionByName(handed).groupBy("a", "b").agg(F.max("moved").alias("moved")), "edges")
        if after.filter("moved").isEmpty():
            roots = after.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            return after.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
        tree = after.select("a", "b")
