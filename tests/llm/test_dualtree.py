"""Centroid clustering by two trees against plain loops."""

import random

import numpy as np
import pytest

from quarry.llm import dualtree


def plain(points, centroids):
    d = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def data(kind, n, rng):
    if kind == "spread":
        return rng.integers(-60, 60, (n, 64))
    if kind == "copies":
        return np.repeat(rng.integers(-9, 9, (3, 64)), (n + 2) // 3, axis=0)[:n]
    if kind == "line":
        return np.arange(n)[:, None] * np.ones(64, dtype=np.int64)
    return rng.integers(-60, 60, (7, 64))[rng.integers(0, 7, n)] + rng.integers(-2, 3, (n, 64))


def tree_of(points):
    tree = dualtree.Tree(points, dualtree.LEAF)
    place = np.empty(len(points), dtype=np.int32)
    place[tree.order] = np.arange(len(points))
    tree.nodes[:, dualtree.CENTRE] = place[tree.nodes[:, dualtree.CENTRE]]
    return dualtree.Block(points[tree.order], tree.nodes, tree.radius)


@pytest.mark.parametrize("kind", ["spread", "copies", "line", "clusters"])
@pytest.mark.parametrize("n", [1, 30, 700])
def test_walk_finds_the_nearest_centroid(kind, n):
    rng = np.random.default_rng(n)
    points = data(kind, n, rng).astype(np.int64)
    for k in (1, 2, 16, 50):
        centroids = np.concatenate([points[rng.integers(0, n, (k + 1) // 2)], data("spread", k // 2, rng)]).astype(np.int64)
        block = tree_of(points)
        want, far = plain(block.points, centroids)
        got, distance = block.assigned(centroids)
        assert (got == want).all() and (distance == far).all()
        sums, counts = block.sums(centroids)
        assert (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[c] == block.points[want == c].sum(axis=0)).all() for c in range(k))


def test_tree_covers_and_parts_its_points():
    points = data("clusters", 900, np.random.default_rng(3)).astype(np.int64)
    block = tree_of(points)
    assert sorted(map(tuple, block.points)) == sorted(map(tuple, points))
    for lo, hi, centre, first, many in block.nodes:
        at = int(np.flatnonzero((block.nodes == [lo, hi, centre, first, many]).all(axis=1))[0])
        assert np.sqrt(dualtree.apart(block.points[lo:hi], block.points[centre])).max() <= block.radius[at] + 1e-9
        if many:
            below = block.nodes[first : first + many]
            assert below[0][dualtree.LO] == lo and below[-1][dualtree.HI] == hi and below[0][dualtree.CENTRE] == centre
            centres = block.points[below[:, dualtree.CENTRE]]
            gaps = [np.sqrt(dualtree.apart(centres[i : i + 1], centres[j : j + 1]))[0] for i in range(many) for j in range(i)]
            assert min(gaps) >= block.radius[first : first + many].max() - 1e-9


def test_pairs_are_pruned(monkeypatch):
    """Clustered points are settled as whole nodes: few are compared one by one."""
    points = data("clusters", 3000, np.random.default_rng(1)).astype(np.int64)
    centroids = points[[0, 500, 1000, 1500, 2000, 2500]]
    settled, nearest = tree_of(points).walk(centroids)
    assert (nearest >= 0).sum() < 3000 and (settled >= 0).any()


def test_small_blocks_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(dualtree, "BLOCK", 7)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(4)]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found, centroids = dualtree.cluster(vectors, k=3, rounds=2, size=4)
    points = {i: np.floor(64 * np.array(x, dtype=np.float32).astype(np.float64)).astype(np.int64) for i, x in rows}
    for r in found.collect():
        d = ((points[r.vec_id] - centroids) ** 2).sum(axis=1)
        assert (r.cluster, r.distance) == (d.argmin(), d.min())
    assert found.count() == 50
    with pytest.raises(Exception, match="would not fit a long"):
        dualtree.cluster(spark.createDataFrame([(1, [3e6, 0.0])], "vec_id long, embedding array<double>"), size=2)


def test_empty_and_without_ids(spark):
    for rows in ([], [(None, [1.0] * 64)], [(5, [1.0] * 63)]):
        found, _ = dualtree.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert found.count() == 0
