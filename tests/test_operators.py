"""The chunk store, synchronisation, streams and extraction."""

import io
import json
import zipfile

import pytest

from quarry.operators import sync
from quarry.sources import files

def test_sync_actions(spark):
    listing = spark.createDataFrame(
        [("1", "a", sync.PDF, ["f"], "2024-01-01T00:00:00Z"), ("2", "a", sync.PPTX, ["f"], "t"), ("3", "b", sync.PDF, ["f"], "2024-01-01T00:00:00+00:00"), ("4", "c", "image/png", ["f"], "t"), ("5", "d", sync.PDF, ["g"], "t2")],
        "id string, base string, mime string, parents array<string>, modified string",
    )
    state = spark.createDataFrame([("3", "2024-01-01T00:00:00Z", True, "p", "s"), ("5", "t1", True, "p", "s"), ("9", "t", True, "p", "s")], "id string, modified string, is_indexed boolean, provider string, store string")
    acted = sync.actions(listing, state, "p", "s")
    assert {r.id: r.action for r in acted.collect()} == {"1": "duplicate", "2": "new", "3": "skip", "4": "unsupported", "5": "updated", "9": "removed"}
    assert sync.actions(listing, state, "other", "s").filter("action = 'skip'").count() == 0
    assert sync.counters(acted).first().asDict() == {"files": 6, "new": 1, "updated": 1, "skip": 1, "duplicate": 1, "unsupported": 1, "removed": 1}


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_documents(spark, tmp_path):
    pptx = zipped(**{"ppt/slides/slide10.xml": "<a:t>Ten</a:t>", "ppt/slides/slide2.xml": "<a:t>Two &amp; more</a:t><a:t>body</a:t>", "ppt/slides/slide3.xml": ""})
    docx = zipped(**{"word/document.xml": '<w:p><w:pStyle w:val="Heading1"/><w:t>Head</w:t></w:p><w:p><w:t>one </w:t><w:t>two</w:t></w:p>'})
    for name, data in (("a.pptx", pptx), ("b.docx", docx), ("c.docx", b"broken"), ("d.txt", b"x"), ("e.pptx", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract(files.binary_files(spark, str(tmp_path), "*")).collect()}
    assert [(s.slide, s.title, s.text) for s in got["a.pptx"].sections] == [(2, "Two & more", "Two & more\nbody"), (10, "Ten", "Ten")] and got["a.pptx"].slide_count == 3
    assert [(s.title, s.text) for s in got["b.docx"].sections] == [("Head", "onetwo")]  # runs are trimmed
    assert got["c.docx"].status == "failed" and got["d.txt"].status == "unsupported" and "e.pptx" not in got


def test_slides_json(spark):
    shape = lambda kind, text: {"shape": {"placeholder": {"type": kind}, "text": {"textElements": [{"textRun": {"content": text}}]}}}
    deck = {"slides": [{"pageElements": [shape("BODY", "text\n"), shape("TITLE", "Name")]}, {"pageElements": []}, {"pageElements": [shape(None, "last")]}]}
    got = files.slides_json(spark.createDataFrame([(json.dumps(deck),)], "json string")).collect()
    assert [(r.slide, r.title, r.text) for r in got] == [(1, "Name", "text\nName"), (3, None, "last")]


def test_wrong_vectors_are_errors(spark):
    from pyspark.sql import functions as F

    from quarry.functions import expressions as X

    for a, b in (([1.0], [1.0, 2.0]), ([], []), ([float("nan")], [1.0]), ([float("inf")], [1.0])):
        frame = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        with pytest.raises(Exception, match="vector"):
            frame.select(X.cosine(F.col("a"), F.col("b"))).collect()
        if a != [1.0]:
            with pytest.raises(Exception, match="vector"):
                frame.select(X.normalised(F.col("a"))).collect()


def test_hash_of_a_pair_of_units(spark):
    from pyspark.sql import functions as F

    from quarry.functions import expressions as X
    from quarry.operators.embedding import _fnv

    texts = ["", "a", "a\U0001f600", "é漢"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.fnv1a(F.col("t"))).collect()
    assert [r[0] for r in got] == [_fnv(t) for t in texts]


def test_sample_smaller_than_the_strata(spark):
    from quarry.operators.sampling import stratified

    rows = spark.createDataFrame([(f"f{k}", "A" if k < 90 else "B" if k < 95 else "C") for k in range(100)], "id string, category string")
    assert [r.category for r in stratified(rows, 2).collect()] == ["A", "A"]


def test_labels_and_ids(spark):
    import hashlib

    from pyspark.sql import functions as F

    from quarry.functions import expressions as X

    c = F.col
    row = spark.createDataFrame([("rrf", 1 / 61, 3, None, "s", "a<b & c>", "x.PPTX", "dim=3;p=a%20b%2Bc", 'q"1')], "kind string, score double, page int, slide int, sec string, t string, name string, d string, v string")
    got = row.select(X.score_label(c("kind")), X.display_score(c("score"), c("kind")), X.location_label(c("page"), c("slide"), c("sec")), X.location_label(c("slide"), c("slide"), c("sec")), X.chat_escaped(c("t")), X.shortened(c("t"), 3),
                     X.document_format(c("name"), F.lit(None).cast("string")), X.document_id(c("name"), c("t")), X.descriptor_value(c("d"), "p"), X.descriptor_value(c("d"), "q"), X.csv_value(c("v")), X.percent_encoded(F.lit("a b+(c)"))).first()
    digest = hashlib.sha256("x.PPTX\0a<b & c>".encode()).hexdigest()[:16]
    assert list(got) == ["RRF統合スコア", 0.5, "Page 3", "s", "a&lt;b &amp; c&gt;", "a<b…", "SLIDES", f"document-{digest}", "a b+c", None, '"q""1"', "a%20b%2B(c)"]
