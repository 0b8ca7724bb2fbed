"""Centroid clustering: Lloyd's rounds by two trees.

Vectors stay where they are read: each task cuts its rows into blocks of bounded size and builds a
cover tree over each, once. A node has a centre that is one of its points, all of them within its
radius; its children are a net of it, found by farthest-first traversal: their centres lie at least as
far apart as the radius that they cover, and the first has the node's own centre. Each round builds
such a tree over the centroids, and walks both by levels: a pair of nodes goes when its least
distance exceeds a bound on how far any point of the one lies from its nearest centroid. A node left
with one centroid is settled as a whole, its sum taken from running sums; what reaches the leaves is
compared exactly, in whole numbers. Only sums and counts of centroids leave the tasks, and only
they reach the driver: their size is centroids x components, whatever the number of vectors.

Vectors that are null, have another length, or hold null or non-finite components take no part;
their rows are not in the result. Components beyond 2^21 are an error, since distances would not fit
a long. Ids may be null (such a vector is assigned, but cannot be a first centroid) or repeated (each
row is a vector; of equal hashes the lesser vector comes first). Ties go to the smaller centroid.
An empty table, or one without ids, gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, spill, table

#: What a query of the driver's tables asks for.
SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors of a block, points of a leaf, children of a node.
BLOCK, LEAF, CHILDREN = 4096, 24, 32
#: Components (before scaling) whose distances fit a long, and centroid components that are sent to tasks.
MOST_COMPONENT, MOST_SENT = 1 << 21, 1 << 22
LO, HI, CENTRE, FIRST, MANY = range(5)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Tree:
    """``order``: the points by leaves; ``nodes``: range in it, centre (a point), first child and number
    of children; ``radius`` of each node."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        nodes, radii, todo = [[0, len(points), 0, 0, 0]], [0.0], [0]
        for at in todo:  # grows while it is read
            lo, hi, centre = nodes[at][:3]
            own = self.order[lo:hi]
            here = points[own]
            near = apart(here, points[centre])
            radii[at] = float(np.sqrt(near.max()))
            if hi - lo <= leaf or not radii[at]:
                continue
            centres, child = [centre], np.zeros(hi - lo, dtype=np.int64)
            target = near.max() // 4  # half the radius
            while len(centres) < CHILDREN and near.max() > target:
                far = int(near.argmax())
                found = apart(here, here[far])
                closer = found < near
                child[closer], near[closer] = len(centres), found[closer]
                centres.append(int(own[far]))
            by_child = np.argsort(child, kind="stable")
            self.order[lo:hi] = own[by_child]
            ends = lo + np.cumsum(np.bincount(child, minlength=len(centres)))
            nodes[at][FIRST:] = [len(nodes), len(centres)]
            for start, end, c in zip([lo, *ends[:-1]], ends, centres, strict=True):
                todo.append(len(nodes))
                nodes.append([int(start), int(end), c, 0, 0])
                radii.append(0.0)
        self.nodes, self.radius = np.array(nodes, dtype=np.int32), np.array(radii)


def children(nodes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of the nodes, and the place in ``which`` of each one's parent."""
    many = nodes[which, MANY]
    parent = np.repeat(np.arange(len(which)), many)
    within = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)
    return nodes[which, FIRST][parent] + within, parent


class Block:
    """Vectors with their tree, kept in the order of its leaves."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.points, self.nodes, self.radius = points, nodes, radius

    def walk(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each node that is settled as a whole (else -1), and of each point."""
        tree = Tree(centroids, 1)
        bound = np.full(len(self.nodes), np.inf)
        settled, nearest = np.full(len(self.nodes), -1), np.full(len(self.points), -1)
        q, t = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        while len(q):
            leaf = self.nodes[q, MANY] == 0
            while True:
                d = np.sqrt(apart(self.points[self.nodes[q, CENTRE]], centroids[tree.nodes[t, CENTRE]]))
                np.minimum.at(bound, q, d + self.radius[q])
                slack = 1e-9 * (1 + bound[q])
                keep = d - self.radius[q] - tree.radius[t] <= bound[q] + slack
                q, t, leaf = q[keep], t[keep], leaf[keep]
                open_ = (tree.nodes[t, MANY] > 0) & (leaf | (tree.radius[t] >= self.radius[q]))
                if not open_.any():
                    break
                found, parent = children(tree.nodes, t[open_])
                q, t, leaf = (np.concatenate([x[~open_], y]) for x, y in ((q, q[open_][parent]), (t, found), (leaf, leaf[open_][parent])))
            alone = (np.bincount(q, minlength=len(self.nodes))[q] == 1) & (tree.nodes[t, MANY] == 0) & (tree.radius[t] == 0)
            # equal centroids share a leaf: ties go to the smaller one
            first = np.array([min(tree.order[n[LO] : n[HI]]) for n in tree.nodes]) if len(q) else np.empty(0, np.int64)
            settled[q[alone]] = first[t[alone]]
            self._compare(q[leaf & ~alone], first[t[leaf & ~alone]], centroids, nearest)
            rest = ~alone & ~leaf
            found, parent = children(self.nodes, q[rest])
            bound[found] = np.minimum(bound[found], bound[q[rest]][parent])
            q, t = found, t[rest][parent]
        return settled, nearest

    def _compare(self, leaves: np.ndarray, candidates: np.ndarray, centroids: np.ndarray, nearest: np.ndarray) -> None:
        """Points of leaves against the centroids left for them, in order, so that ties go to the smaller."""
        best = np.full(len(self.points), np.iinfo(np.int64).max)
        for c in np.unique(candidates):
            at = leaves[candidates == c]
            lo, hi = self.nodes[at, LO], self.nodes[at, HI]
            own = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))
            d = apart(self.points[own], centroids[c])
            closer = own[d < best[own]]
            best[own] = np.minimum(best[own], d)
            nearest[closer] = c

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the vectors of each centroid."""
        settled, nearest = self.walk(centroids)
        sums, counts = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        running = np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])
        whole = np.flatnonzero(settled >= 0)
        lo, hi = self.nodes[whole, LO], self.nodes[whole, HI]
        np.add.at(sums, settled[whole], running[hi] - running[lo])
        np.add.at(counts, settled[whole], hi - lo)
        single = np.flatnonzero(nearest >= 0)
        np.add.at(sums, nearest[single], self.points[single])
        np.add.at(counts, nearest[single], 1)
        return sums, counts

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each vector and its squared distance."""
        settled, nearest = self.walk(centroids)
        for at in np.flatnonzero(settled >= 0):
            nearest[self.nodes[at, LO] : self.nodes[at, HI]] = settled[at]
        return nearest, apart(self.points, centroids[nearest])


def kept(vectors: DataFrame, size: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.filter((F.size(x) == size) & whole).select(F.col(id_col).alias("vec_id"), x.cast("array<double>").alias("embedding"))


def scaled(vectors: pa.Array, size: int, scale: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    if len(x) and np.abs(x).max() > MOST_COMPONENT:
        raise ValueError(f"components beyond {MOST_COMPONENT}: squared distances would not fit a long")
    return np.floor(scale * x).astype(np.int64)


_BLOCKS = "vec_id array<long>, points binary, nodes binary, radius binary"


def blocks(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """The kept vectors in blocks, each with its cover tree."""

    def built(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        tree = Tree(points, LEAF)
        place = np.empty(len(points), dtype=np.int32)
        place[tree.order] = np.arange(len(points))
        tree.nodes[:, CENTRE] = place[tree.nodes[:, CENTRE]]
        row = [[ids.take(pa.array(tree.order)).to_pylist()], [points[tree.order].astype(np.int32).tobytes()], [tree.nodes.tobytes()], [tree.radius.tobytes()]]
        types = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["vec_id", "points", "nodes", "radius"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids.append(part.column(0))
                points.append(scaled(part.column(1), size, scale))
                held += part.num_rows
                while held >= BLOCK:
                    all_ids, all_points = pa.concat_arrays(ids), np.concatenate(points)
                    yield built(all_ids.slice(0, BLOCK), all_points[:BLOCK])
                    ids, points, held = [all_ids.slice(BLOCK)], [all_points[BLOCK:]], held - BLOCK
        if held:
            yield built(pa.concat_arrays(ids), np.concatenate(points))

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(lean(run), _BLOCKS)


def _read(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, Block]]:
    for batch in batches:
        for at in range(batch.num_rows):
            points, nodes, radius = (np.frombuffer(batch.column(k)[at].as_py(), t) for k, t in ((1, np.int32), (2, np.int32), (3, np.float64)))
            yield batch.column(0).slice(at, 1).flatten(), Block(points.reshape(-1, size).astype(np.int64), nodes.reshape(-1, 5), radius)


def first_centroids(vectors: DataFrame, k: int, size: int, scale: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``<seed>:<vec_id>``."""
    own = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id IS NOT NULL").select(own.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()  # k rows
    return scaled(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), size, scale)


def moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floors of means, where there are vectors."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for _, block in _read(batches, size):
            more = block.sums(centroids)
            sums, counts = sums + more[0], counts + more[1]
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(list(np.column_stack([counts, sums])[found]), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = stored.mapInArrow(lean(run), "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "part"))
    rows = parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("s")).collect()  # centroids x components
    total = {(r["cluster"], r["at"]): int(r["s"]) for r in rows}
    return np.array([[total[c, j + 1] // total[c, 0] for j in range(size)] if (c, 0) in total else list(centroids[c]) for c in range(len(centroids))], dtype=np.int64)


def assigned(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _read(batches, centroids.shape[1]):
            cluster, distance = block.assigned(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(lean(run), "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The assignment (vec_id, cluster, distance) after some rounds, stored, and the last centroids."""
    if k * size > MOST_SENT:
        raise ValueError(f"centroids have {MOST_SENT} components at most")
    own = kept(vectors, size, id_col, vector_col)
    centroids = first_centroids(own, k, size, scale, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    stored = spill(blocks(own, size, scale), "trees")
    for _ in range(rounds):
        centroids = moved(stored, centroids)
    return spill(assigned(stored, centroids), "clusters"), centroids


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """All vectors of the table, with the inertia of each cluster and of all."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    rows = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # a row for each centroid
    whole = sum(int(r["s"]) for r in rows)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = spark.createDataFrame([(r["cluster"], int(r["s"]), whole, hashes[r["cluster"]]) for r in rows], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(size: int = SIZE, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same by comparing every vector with every centroid."""
    square = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda e: (e[1] - e[2]) * (e[1] - e[2]))) AS BIGINT)"

    steps = []
    for at in range(rounds + 1):
        steps.append(f"""a{at} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.row, v.vec_id, v.x, c.c, {square} AS d FROM v, c{at} c) GROUP BY row)""")
        if at < rounds:
            steps.append(f"""m{at + 1} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range({size})) AS i FROM a{at}) GROUP BY c, i) GROUP BY c)""")
            steps.append(f"c{at + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{at} c LEFT JOIN m{at + 1} m ON m.c = c.c)")
    last = f"a{rounds}"
    return f"""WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
    WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size}),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k})),
{", ".join(steps)},
i AS (SELECT c, sum(d) AS s FROM {last} GROUP BY c)
SELECT vec_id, CAST({last}.c AS INT) AS cluster, d AS distance, CAST(s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM {last}) AS BIGINT) AS inertia,
    sha256(array_to_string(cc.x, ',')) AS centroid_sha256 FROM {last} JOIN i ON i.c = {last}.c JOIN c{rounds} cc ON cc.c = {last}.c"""


OP12_SQL = oracle_sql()
