"""The tree of folders as a data source, index documents, and the re-ranker."""

import pytest
from pyspark.sql import functions as F

from quarry.operators.reranking import Reranker, features
from quarry.sources.files import local_index, write_index
from quarry.sources.tree import contents, tree


@pytest.fixture
def folder(tmp_path):
    for name, text in (("a.PDF", "x"), ("b/c.txt", "text"), ("b/d/e.json", "{}"), ("b/d/f", ""), ("g/_hidden.txt", "no"), ("h/i/j/k.docx", "zip")):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "root")


def test_tree_lists_every_file_once(spark, folder):
    found = tree(spark, folder)
    rows = {r.id: (r.name, r.parent, r["size"]) for r in found.collect()}
    assert rows == {"a.PDF": ("a.PDF", ".", 1), "b/c.txt": ("c.txt", "b", 4), "b/d/e.json": ("e.json", "b/d", 2), "b/d/f": ("f", "b/d", 0), "h/i/j/k.docx": ("k.docx", "h/i/j", 3)}
    assert found.rdd.getNumPartitions() == 4
    assert {r.mime for r in found.collect()} >= {"application/pdf", "text/plain", "application/octet-stream"}


def test_filters_are_taken_over(spark, folder):
    found = tree(spark, folder).filter("mime = 'text/plain'").filter(F.col("parent").isin("b", "h")).filter("size > 1")
    assert [r.id for r in found.collect()] == ["b/c.txt"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "(size#" in plan and "text/plain" not in plan and "parent#" in plan and " IN " not in plan


def test_bytes_of_files(spark, folder):
    got = {r.id: None if r.content is None else bytes(r.content) for r in contents(spark, folder, tree(spark, folder)).collect()}
    assert got["b/c.txt"] == b"text" and got["b/d/f"] is None and got["a.PDF"] == b"x"


def test_index_documents_replace_what_was_there(spark, tmp_path):
    rows = [(f"{d}:{k}", f"{d}", k, f"text {k}", [1.0, 2.0]) for d in "abc" for k in range(3)]
    chunks = spark.createDataFrame(rows, "id string, document_id string, chunk_index long, content string, embedding array<double>")
    for part in (chunks, chunks.filter("document_id <> 'b'")):
        write_index(part, str(tmp_path / "i"), "p", 2, parts=2)
    back = local_index(spark, str(tmp_path / "i"))
    assert sorted(r.id for r in back.collect()) == [r[0] for r in rows if r[1] != "b"]
    assert {(r.version, r.embeddingProviderId) for r in back.collect()} == {(1, "p")}


def test_features():
    assert features("a b c d", "x a b c d")[:3] == [1.0, 1.0, 1.0]
    assert features("a b", "b a")[:2] == [1.0, 0.0] and features("", "a")[:3] == [0.0] * 3 and features("a", "")[:4] == [0.0] * 4


def test_reranker_learns_saves_and_scores(spark, tmp_path):
    rows = [(f"q{k} r{k} s{k}", f"pad {'x ' * (k % 5)}" + (f"q{k} r{k} s{k}" if k % 2 else f"q{k} y"), k % 2) for k in range(40)] + [("q", None, 0), (None, "x", 0)]
    pairs = spark.createDataFrame(rows, "query string, text string, label int")
    ranker = Reranker.trained(pairs)
    ranker.save(spark, str(tmp_path / "m"))
    again = Reranker.load(spark, str(tmp_path / "m"))
    assert again.weights == ranker.weights
    scored = pairs.withColumn("relevance", again.relevance(F.col("query"), F.col("text"))).collect()
    assert min(r.relevance for r in scored if r.label) > max(r.relevance for r in scored if not r.label)
    texts = spark.createDataFrame([("a", "q1 r1 s1"), ("b", "none")], "document_id string, text string")
    found = spark.createDataFrame([("a",), ("b",), ("gone",)], "document_id string")
    by_id = {r.document_id: r.relevance for r in again.for_search(texts)("q1 r1 s1", found).collect()}
    assert by_id["a"] > by_id["b"] and set(by_id) == {"a", "b", "gone"}
    with pytest.raises(ValueError, match="weights"):
        Reranker([1.0])
