"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quarry.operators import chunking, retrieval
from quarry.operators.sampling import stratified
from quarry.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str([None if pd.isna(x) else x for x in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_oracle(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLES[name]).df())


def test_chunks_are_bounded_and_overlap(spark):
    text = "First sentence here. " * 200
    got = chunking.pieces(text, 300, 50)
    assert all(0 < len(x) <= 300 for x in got) and all(x.endswith(".") for x in got)
    assert chunking.pieces("", 300, 50) == [] and chunking.pieces("a b", 300, 0) == ["a b"]
    with pytest.raises(ValueError):
        chunking.pieces("x", 10, 10)
    frame = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = chunking.chunk_documents(frame, 300, 50).collect()
    assert [r.content for r in found] == got and [r.chunk_index for r in found] == list(range(len(got)))


def test_levels_of_candidates():
    assert retrieval.levels(3) == [100, 200, 400, 500] and retrieval.levels(20) == [400, 500]


def test_grouping_keeps_the_best_chunk(spark):
    hits = spark.createDataFrame([("a", 0, 0.84), ("b", 1, 0.82), ("a", 2, 0.88)], "document_id string, ordinal long, score double")
    got = [(r.document_id, r.score, [x.score for x in r.related]) for r in retrieval.grouped(hits, 5).collect()]
    assert got == [("a", 0.88, [0.84]), ("b", 0.82, [])]


def test_sample_keeps_a_rare_stratum(spark):
    files = spark.createDataFrame([(f"f{k}", "PDF" if k < 30 else "PPTX" if k < 99 else "DOCX") for k in range(100)], "id string, category string")
    got = stratified(files, 10).groupBy("category").count().collect()
    assert sum(r["count"] for r in got) == 10 and {r.category: r["count"] for r in got}["DOCX"] == 1
    assert stratified(files, 200).count() == 100
