"""Nearest neighbours by one-bit codes against brute force."""

import numpy as np
import pytest

from quarry.llm import onebit


def brute(rows, each=50, k=5):
    rows = sorted({(i, tuple(x)) for i, x in rows})
    out = []
    for q, x in rows:
        if q % each == 0:
            others = [(i, y) for i, y in rows if (i, y) != (q, x)]
            scores = onebit.exact(np.array([x] * len(others)), np.array([y for _, y in others]))
            out.append((q, [(i, s) for s, i in sorted(zip(-scores, [i for i, _ in others], strict=True))[:k]]))
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, -s) for _, i, s in sorted(v)] for q, v in out.items()}


def rows_of(kind, n, size, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "copies":  # a third of the rows are one vector, more are in groups
        x = rng.standard_normal((n, size))
        x[: n // 3] = x[0]
        x[n // 3 : n // 2] = x[n // 3 + np.arange(n // 2 - n // 3) % 7]
    elif kind == "clusters":
        x = rng.standard_normal((9, size))[rng.integers(0, 9, n)] + 0.05 * rng.standard_normal((n, size))
    else:
        x = rng.standard_normal((n, size))
    return [(i * 5, x[i].tolist()) for i in rng.permutation(n).tolist()]


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
@pytest.mark.parametrize("size", [3, 64, 100])
def test_recall_with_many_small_cells(spark, monkeypatch, kind, size):
    monkeypatch.setattr(onebit, "CELL", 60)
    monkeypatch.setattr(onebit, "BLOCK_NUMBERS", 40 * size)
    monkeypatch.setattr(onebit, "QUERY_NUMBERS", 5 * size)
    rows = rows_of(kind, 600, size)
    got = found(onebit.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)))
    want = dict(brute(rows))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    assert all(len(got[q]) == 5 for q in want)


def test_few_rows_and_probes(spark):
    rows = rows_of("spread", 4, 8)
    got = found(onebit.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert {q: len(v) for q, v in got.items()} == {0: 3}
    rows = rows_of("clusters", 300, 16)
    got = found(onebit.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probes=1))
    assert all(len(v) == 5 for v in got.values()) and len(got) == 30


def test_estimates_lie_within_their_bound():
    x = onebit.units(np.random.default_rng(4).standard_normal((500, 96)))
    centre = x[:50].mean(axis=0)
    turn = onebit.rotation(onebit.words(96))
    assert np.allclose(turn @ turn.T, np.eye(128))
    guess, off = onebit.estimates(onebit.Asked(x[:40], centre, turn), onebit.Codes(x, centre, turn))
    missed = np.abs(guess - x[:40] @ x.T)
    assert (missed <= off).mean() > 0.999 and off.mean() < 0.6


def test_empty(spark):
    for rows in ([], [(1, None)], [(None, [1.0])], [(50, [0.0, 0.0])]):
        assert onebit.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0
