"""The posting index, folder trees, reports, collections, settings and the command line."""

import csv
import io
import json
from datetime import datetime

import pytest

from quarry import __main__ as command
from quarry.operators import collection, evaluation, listing, reports, retrieval
from quarry.operators.postings import PostingIndex
from quarry.operators.store import IncompatibleStore
from quarry.settings import Settings


def test_index_scores_as_the_plain_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Red fox, red hen"), (2, None), (3, ""), (4, "a hen and a fox"), (5, "blue")], "doc_id long, text string")
    index = PostingIndex(spark, str(tmp_path)).build(docs)
    for terms in (["red", "fox"], ["absent"], []):
        assert dict(index.search(terms).collect()) == pytest.approx(dict(retrieval.bm25(docs, terms).collect()))
    PostingIndex(spark, str(tmp_path / "none")).build(docs.limit(0))
    assert PostingIndex(spark, str(tmp_path / "none")).search(["red"]).collect() == []


def test_index_reads_only_the_terms_lists(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(1, "red fox")], "doc_id long, text string")
    PostingIndex(spark, str(tmp_path)).build(docs).search(["red"]).explain()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,red)]" in capsys.readouterr().out


def test_a_cycle_of_folders_ends(spark):
    edges = [("a", "root", True), ("b", "a", True), ("root", "b", True), ("b", "root", True), ("f", "b", False), ("g", "loose", False), ("f", "a", False)]
    frame = spark.createDataFrame(edges, "id string, parent string, is_folder boolean")
    assert sorted(r.parent for r in listing.reached(frame, "root").collect()) == ["a", "b", "root"]
    assert sorted((r.id, r.parent) for r in listing.listed(frame, "root").collect()) == [("f", "a"), ("f", "b")]
    assert listing.listed(frame.limit(0), "root").count() == 0


def test_reports_read_back(spark, tmp_path):
    odd = 'a "b",\nc'
    files = spark.createDataFrame([("1", odd, 3), ("2", None, None)], "drive_file_id string, name string, chunk_count long")
    at = datetime(2024, 5, 6, 7, 8, 9)
    summary = spark.createDataFrame([(2,)], "total_files long")
    json_path, csv_path = reports.write_analysis(files, summary, str(tmp_path), at)
    assert json_path.endswith("drive-analysis-20240506-070809.json") and spark.read.json(json_path).first().total_files == 2
    lines = "".join(p.read_text() for p in sorted((tmp_path / csv_path.rsplit("/", 1)[1]).glob("part-*")))
    header, *rows = csv.reader(io.StringIO(lines))
    assert tuple(header) == reports.CELLS and {(r[0], r[1], r[13]) for r in rows} == {("1", odd, "3"), ("2", "", "")}
    assert "files  " in reports.console("Totals", {"files": 12345, "share": None}, [{"format": "PDF", "files": 3}]) and "12,345" in reports.console("t", {"files": 12345})
    run = reports.write_evaluation(files, summary, files.limit(0), {"provider": "local"}, str(tmp_path / "run"))
    assert spark.read.json(f"{run}/run").first().summary.total_files == 2


def test_a_collection_of_another_kind_is_refused(spark, tmp_path):
    path, description = str(tmp_path / "c"), "embeddingProvider=local%3Bv2;dimensions=4"
    assert collection.ensure(spark, path, description, 4, "local;v2").count() == 0
    assert collection.ensure(spark, path, description, 4, "local;v2").columns[-1] == "embedding"
    for dimensions, provider, hybrid in ((8, "local;v2", False), (4, "other", False), (4, "local;v2", True)):
        with pytest.raises(IncompatibleStore):
            collection.ensure(spark, path, description, dimensions, provider, hybrid)
    with pytest.warns(UserWarning):
        collection.check(collection.schema(4), "", 4, "local")
    with pytest.raises(IncompatibleStore):
        collection.check(collection.schema(4, True), "embeddingProvider=local;hybrid=old", 4, "local", True)
    assert collection.alive({"a": spark.range(9), "b": spark.range(0)}) == {"a": 1, "b": 0}


def test_settings():
    given = Settings({"N": " 3 ", "ZERO": "0", "HALF": "1.5", "WORD": "x", "YES": "true", "BLANK": " "})
    assert given.integer("N", 1) == 3 and given.integer("BLANK", 7) == 7 and given.boolean("YES", False) and not given.boolean("BLANK", False)
    for wrong in (lambda: given.integer("ZERO", 1), lambda: given.integer("HALF", 1), lambda: given.integer("WORD", 1), lambda: given.boolean("WORD", True), lambda: given.required("BLANK"), lambda: given.one_of("WORD", ("a", "b"), "a")):
        with pytest.raises(ValueError):
            wrong()


def test_cases_are_chosen(capsys):
    cases = {"cases": [{"id": "a", "category": "x", "query": "q"}, {"id": "b", "category": "y", "query": "r"}]}
    assert [c["id"] for c in evaluation.chosen_cases(cases, category="y")] == ["b"] and len(evaluation.chosen_cases(cases)) == 2
    with pytest.raises(ValueError):
        evaluation.chosen_cases(json.loads(json.dumps(cases)), "a", "y")
    command.main(["queries"])
    assert "posting_search" in capsys.readouterr().out
