"""Extraction as a table function, and the pages of PDFs."""

import json
import zlib

import pytest

from quarry.plans import fixture_files
from quarry.plans.fixtures import DOCS, DOCX, PDF, PPTX, SLIDES
from quarry.sources import extraction, pdf
from quarry.sources.extraction import Given, Refused, downloaded

FILE = "id string, mime string, content binary, faults array<string>, node int"


@pytest.fixture(scope="module")
def analyse(spark):
    extraction.register(spark, "analyse_file", wait_s=0)

    def run(*rows, **more):
        files = spark.createDataFrame([(f"f{k}", m, None if c is None else bytearray(c), f, k) for k, (m, c, f) in enumerate(rows)], FILE)
        return [r.asDict() for r in extraction.analyse(files, **more).orderBy("node").collect()]

    return run


def test_a_status_for_every_file(analyse):
    good = {m: make("Title line\nSome more text") for m, make in fixture_files.MAKERS.items()}
    found = analyse(
        (PDF, good[PDF], None), (PPTX, good[PPTX], []), (SLIDES, good[SLIDES], None), (DOCX, good[DOCX], None), ("image/png", b"x", None), (None, b"x", None),
        (PDF, b"no pdf", None), (PPTX, b"no zip", None), (SLIDES, b"{", None), (PDF, None, None), (PDF, b"", None), (DOCX, fixture_files.docx(" \n "), None),
        (PDF, good[PDF], ["insufficientFilePermissions"]), (PDF, good[PDF], ["somethingElse"]),
    )
    assert [r["status"] for r in found] == ["success"] * 4 + ["unsupported"] * 2 + ["extraction_failed"] * 5 + ["empty_document", "permission_error", "extraction_failed"]
    assert [r["page_count"] for r in found[:4]] == [1, None, None, None] and [r["slide_count"] for r in found[:4]] == [None, 1, 1, None]
    assert [r["reason"] for r in found[-2:]] == ["insufficientFilePermissions", "unknown"]
    assert all(r["chunk_count"] == 1 and r["extracted_characters"] == 25 == r["chunk_text_characters"] and r["metadata_payload_bytes"] > 0 for r in found[:4])
    assert "sections" not in found[0]


def test_retries(analyse):
    good = fixture_files.pdf("text")
    found = analyse((PDF, good, ["503", "ETIMEDOUT"]), (PDF, good, ["429", "500", "503"]), (PDF, good, ["404"]), (PDF, good, ["cannotDownloadAbusiveFile+"]), (DOCX, good, ["cannotDownloadAbusiveFile+"]), acknowledge=True)
    assert [(r["status"], r["attempts"]) for r in found] == [("success", 3), ("extraction_failed", None), ("extraction_failed", None), ("success", 1), ("skipped_abusive_file", None)]
    assert analyse((PDF, good, ["cannotDownloadAbusiveFile+"]))[0]["status"] == "skipped_abusive_file"


def test_waits_double(monkeypatch):
    waits = []
    monkeypatch.setattr(extraction.time, "sleep", waits.append)
    assert downloaded(Given(b"x", ["500", "EAI_AGAIN"]), "f", PDF, False) == (b"x", 3) and waits == [0.5, 1.0]
    with pytest.raises(Refused):
        downloaded(Given(b"x", ["cannotDownloadAbusiveFile"] * 3), "f", PDF, True)
    with pytest.raises(ValueError, match="empty"):
        downloaded(Given(b"", None), "f", PDF, True)


def test_sections_on_demand_and_own_extractors(spark, analyse):
    found = analyse((PDF, fixture_files.pdf("a" * 1500 + "second page"), None), (DOCX, fixture_files.docx("line"), None), with_sections=True)
    assert [(s["text"], s["page"]) for s in found[0]["sections"]] == [("a" * 1500, 1), ("second page", 2)]
    upper = extraction.Extractor(("text/plain", PDF), lambda data: extraction.Extracted([{"text": data.decode().upper(), "page": 4, "slide": None, "title": None}]))
    extraction.register(spark, "own", (upper, *extraction.EXTRACTORS), wait_s=0)
    files = spark.createDataFrame([("f", "text/plain", bytearray(b"hi"), None, 0)], FILE)
    row = extraction.analyse(files, "own", with_sections=True).first()
    assert (row.status, row.page_count, row.sections[0].text) == ("success", 1, "HI")
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT * FROM own('f', 'text/plain', true, rand() > 0.5, cast('x' as binary), array(''))").collect()
    with pytest.raises(Exception, match="string is expected"):
        spark.sql("SELECT * FROM own(1, 'text/plain', true, true, cast('x' as binary), array(''))").collect()
    assert extraction.analyse(files.limit(0)).count() == 0


def test_slides_of_a_service():
    slide = {"pageElements": [{"shape": {"placeholder": {"type": "TITLE"}, "text": {"textElements": [{"textRun": {"content": " T "}}]}}}, {"shape": {"text": {"textElements": [{"autoText": {"content": "2"}}]}}}, {}]}
    found = extraction.slides_of_json(json.dumps({"slides": [{}, slide]}).encode())
    assert found == extraction.Extracted([{"text": "T\n2", "page": None, "slide": 2, "title": "T"}], None, 2)


# -- PDF ----------------------------------------------------------------------------------
def test_pdf_round_trip():
    text = "Ünïcode 漢字 – ﬁ\nsecond line\n\nafter a blank \U0001f600" * 90
    want = ["\n".join(x for x in p.replace("ﬁ", "fi").split("\n") if x) for p in fixture_files.parts(text)]
    got = pdf.pages_of(fixture_files.pdf(text))
    assert [" ".join(g.split()) for g in got] == [" ".join(w.split()) for w in want] and len(got) > 1


def one_page(content, resources="", head=""):
    return f"%PDF-1.4\n{head}1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj\n3 0 obj << /Type /Page /Contents 4 0 R /Resources << {resources} >> >> endobj\n4 0 obj << /Length {len(content)} >> stream\n{content}\nendstream endobj\ntrailer << /Root 1 0 R >>".encode("latin-1")


def test_pdf_operators():
    shown = r"BT (Plain \(nested (x)\) \101\n) Tj [(two) -300 (words) 20 (!)] TJ 0 -12 Td (next) ' /F9 1 Tf (a) Tj 5 0 Td (b) Tj ET BT 1 0 0 1 0 700 Tm (c) Tj 1 0 0 1 0 690 Tm (d) Tj ET BI /W 1 ID (junk) Tj EI (end) Tj"
    assert pdf.pages_of(one_page(shown)) == ["Plain (nested (x)) A\ntwo words!\nnexta b\nc\nd\nend"]


def test_pdf_forms_comments_and_revisions():
    form = "5 0 obj << /Subtype /Form /Length 12 >> stream\n(in form) Tj\nendstream endobj\n"
    assert pdf.pages_of(one_page("/X Do % (comment) Tj\n(<41>) Tj <4 1> Tj", "/XObject << /X 5 0 R >>", form)) == ["in form<41>A"]
    old = one_page("(old) Tj")
    assert pdf.pages_of(old + b"\n4 0 obj << /Length 8 >> stream\n(new) Tj\nendstream endobj\ntrailer << /Root 1 0 R >>") == ["new"]


@pytest.mark.parametrize("data", [b"", b"%PDF-1.4", b"%PDF-1.4\ntrailer << /Root 9 0 R >>", one_page("(x) Tj").replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 7 0 R"), one_page("(never ends Tj")])
def test_broken_pdfs(data):
    with pytest.raises(pdf.BrokenPdf):
        pdf.pages_of(data)


def test_pdfs_that_refer_to_themselves_end():
    loop = one_page("/X Do (x) Tj", "/XObject << /X 5 0 R >>", "5 0 obj << /Subtype /Form /Length 5 >> stream\n/X Do\nendstream endobj\n")
    assert pdf.pages_of(loop) == ["x"]
    assert pdf.pages_of(b"%PDF-1.4\n1 0 obj << /Pages 2 0 R >> endobj 2 0 obj << /Kids [2 0 R] >> endobj trailer << /Root 1 0 R >>") == []
    assert zlib.crc32(b"") == 0 and DOCS not in fixture_files.MAKERS


def test_files_are_made_by_the_hundred(spark):
    """no Arrow batch of 10,000 texts and files in a worker; null texts and other types as before."""
    from pyspark.sql import functions as F

    from quarry.plans.fixture_files import contents, pdf
    from quarry.plans.fixtures import PDF

    rows = spark.createDataFrame([(PDF, "a\nb"), (PDF, None), ("image/png", "x"), (None, "x")], "mime string, text string")
    made = rows.select(contents(F.col("mime"), F.col("text")).alias("c"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [r.c for r in made.collect()] == [pdf("a\nb"), pdf(""), None, None]
