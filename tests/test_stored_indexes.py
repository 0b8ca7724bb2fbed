"""The dense index and the block index against plain searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import session
from quarry.operators import dense_index, postings, retrieval
from quarry.operators.dense_index import DenseIndex
from quarry.operators.postings import BlockIndex, PostingIndex
from quarry.plans import store_queries

VECTOR = "id string, embedding array<double>, list int, codes int"


def vectors(n=900, size=20, seed=3):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((12, size))[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, size))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(f"v{k}", x.tolist(), 0, 0) for k, x in enumerate(vectors())]
    odd = [("null", None, 0, 0), ("empty", [], 0, 0), ("zero", [0.0] * 20, 0, 0), ("nan", [float("nan")] * 20, 0, 0), ("part", [None] + [1.0] * 19, 0, 0), ("copy", rows[5][1], 0, 0)]
    frame = spark.createDataFrame(rows + odd, VECTOR)
    return DenseIndex(spark, str(tmp_path_factory.mktemp("dense"))).build(frame)


def true(query, k=10):
    x = vectors()
    scores = (x @ query) / np.linalg.norm(x, axis=1) / np.linalg.norm(query)
    return [f"v{i}" for i in np.argsort(-scores)[:k]]


def test_recall_and_exact_search(index):
    assert len(index.model["centroids"]) == 9 and 1 <= index.model["probes"] <= 9
    hits, queries = 0, vectors()[::45] + 0.05
    for q in queries[:6]:
        hits += len(set(true(q)) & {r.id for r in index.search(q.tolist(), 10).collect()})
        found = [r.id for r in index.exact(q.tolist(), 12).collect() if r.id != "copy"][:10]
        assert found == true(q)
    assert hits >= 54


def test_many_queries_at_once(spark, index):
    queries = vectors()[::45] + 0.05
    frame = spark.createDataFrame([(k, q.tolist()) for k, q in enumerate(queries)], "query long, vector array<double>")
    found: dict = {}
    for r in index.search_all(frame, 10).collect():
        found.setdefault(r["query"], set()).add(r["id"])
    assert all(len(v) == 10 for v in found.values()) and len(found) == 20
    assert sum(len(set(true(q)) & (found[k])) for k, q in enumerate(queries)) >= 180


def test_a_search_reads_the_probed_lists_only(index):
    q = vectors(1, seed=9)[0].tolist()
    which = index.probed(q, 2)
    read = index.lists().filter(F.col("list").isin(which))
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and len({r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect()}) <= len(read.inputFiles())
    assert {r.list for r in read.select("list").distinct().collect()} == set(which)


def test_index_of_nothing_and_of_mixed_lengths(spark, tmp_path):
    none = DenseIndex(spark, str(tmp_path / "a")).build(spark.createDataFrame([("x", None, 0, 0)], VECTOR))
    assert none.search([1.0], 3).count() == 0
    with pytest.raises(ValueError, match="one length"):
        DenseIndex(spark, str(tmp_path / "b")).build(spark.createDataFrame([("x", [1.0], 0, 0), ("y", [1.0, 2.0], 0, 0)], VECTOR))
    one = DenseIndex(spark, str(tmp_path / "c")).build(spark.createDataFrame([("x", [1.0, 1.0], 0, 0)], VECTOR))
    assert [r.id for r in one.search([1.0, 0.0], 3).collect()] == ["x"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(400):
        own = [f"{'abc'[k % 3]}{int(x)}" for x in rng.zipf(1.6, 5 + k % 90).clip(max=60)]
        rows.append((k, " ".join(own)))
    return spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, rows[7][1]), (1003, "... !")], "doc_id long, text string").withColumn("term", F.lit("x")).repartition(3)


@pytest.fixture(scope="module")
def blocks(spark, corpus, tmp_path_factory):
    return BlockIndex(spark, str(tmp_path_factory.mktemp("blocks"))).build(corpus, shard=16)


@pytest.mark.parametrize("terms", [["a1"], ["a1", "a2", "b1"], ["c40", "a3"], ["none"], [], ["a1", "a1"]])
@pytest.mark.parametrize("k", [1, 10, 1000])
def test_topk_is_that_of_all_postings(blocks, corpus, terms, k):
    want = retrieval.bm25(corpus, sorted(set(terms))).orderBy(F.desc("score"), "doc_id").limit(k).collect() if terms else []
    got, counts = blocks.topk(terms, k)
    assert [(r.doc_id, round(r.score, 9)) for r in got.collect()] == [(r.doc_id, round(r.score, 9)) for r in want]
    assert counts["read"] <= counts["blocks"]


def test_blocks_are_skipped(blocks):
    _, counts = blocks.topk(["a2", "b2"], 3, first=4)
    assert 0 < counts["read"] < counts["blocks"] / 2


def test_blocks_of_nothing(spark, tmp_path):
    empty = BlockIndex(spark, str(tmp_path)).build(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.topk(["a"], 5)[0].count() == 0


def test_truth_of_many_queries_in_parts(spark, index, monkeypatch):
    monkeypatch.setattr(dense_index, "TOGETHER", 64)
    monkeypatch.setattr(dense_index, "ASKED", 5)
    queries = vectors()[::45] + 0.05
    frame = spark.createDataFrame([(k, q.tolist()) for k, q in enumerate(queries)], "query long, vector array<double>")
    want = {k: [r.id for r in index.exact(q.tolist(), 10).collect()] for k, q in enumerate(queries)}
    for found in (index.exact_all(frame, 10), index.search_all(frame, 10, probes=9, again=100)):
        got: dict = {}
        for r in found.orderBy("query", F.desc(F.round("score", 12)), "id").collect():
            got.setdefault(r["query"], []).append(r["id"])
        assert got == want


def test_a_task_hands_on_its_best_candidates_alone():
    scores = np.array([[1.0, 3.0, 3.0, 3.0, -np.inf], [5.0, 4.0, 3.0, 2.0, 1.0]])
    row, column, _ = dense_index._first(scores, np.array([0, 3, 2, 1, 4]), 2)
    assert list(zip(row, column, strict=True)) == [(0, 2), (0, 3), (1, 0), (1, 1)]


def test_words_are_counted_where_their_documents_lie(spark, corpus, tmp_path, monkeypatch):
    """Counting the words of a document moves none of them."""
    kept = []
    monkeypatch.setattr(postings, "stored", lambda df, name: kept.append(df) or session.stored(df, name))
    PostingIndex(spark, str(tmp_path / "p")).build(corpus)
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning(doc_id") > plan.index("Generate explode")
    whole = spark.read.parquet(f"{tmp_path}/p/whole").first()
    lengths = corpus.select(F.size(retrieval.words(F.coalesce("text", F.lit("")))).alias("n")).agg(F.count("*"), F.avg("n")).first()
    assert tuple(whole) == tuple(lengths)
    none = PostingIndex(spark, str(tmp_path / "n")).build(corpus.filter("false"))
    assert none.search(["a1"]).count() == 0 and spark.read.parquet(f"{tmp_path}/n/whole").first()["avgdl"] is None


def test_terms_of_blocks_are_counted_where_their_documents_lie(spark, tmp_path):
    tokens = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "doc_id long, w array<string>").withColumn("len", F.size("w"))
    counted = BlockIndex(spark, str(tmp_path))._counted(tokens, 16)
    assert {(r.doc_id, r.term, r.tf, r.len) for r in counted.collect()} == {(1, "a", 2, 3), (1, "b", 1, 3)}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" in plan and "Exchange hashpartitioning" not in plan


def test_recall_of_near_copies_is_that_of_the_sql(spark, tmp_path):
    """Guesses hardly tell near copies apart: as many are scored again as the recall needs. A query without a
    vector is one of the queries."""
    x = np.random.default_rng(5).standard_normal((4000, 64))
    x[1::2] = x[1:5:2].repeat(1000, axis=0) + 0.01 * x[1::2]
    x = x[np.random.default_rng(6).permutation(4000)]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(4000, None), (4050, [0.0] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert [tuple(r) for r in store_queries.dense_index_recall(spark, f"{tmp_path}/a").collect()] == [(82, 10, True)]
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert [tuple(r) for r in store_queries.dense_index_recall(spark, f"{tmp_path}/b").collect()] == [(0, 10, True)]


def test_candidates_are_measured(spark, index, tmp_path):
    """Rows of equal codes, which guesses do not tell apart, are counted by id before the true nearest."""
    assert index.model["again"] >= dense_index.AGAIN
    x = np.repeat(vectors()[:3], 300, axis=0)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    copies = DenseIndex(spark, str(tmp_path)).build(frame)
    assert copies.model["again"] == dense_index.AGAIN
    copies._save(copies.model | {"codebooks": [[[0.0] * len(w[0])] * len(w) for w in copies.model["codebooks"]], "centroids": [[0.0] * 20] * 9})
    behind = copies._measured(vectors()[2:3], 0.95, 10)
    assert behind["again"] == 62  # ids 600 to 610, of which the first is the query itself
