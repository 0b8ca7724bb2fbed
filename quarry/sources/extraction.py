"""Files to sections, one status row for each: sources and extractors are plugged in, a table function
does the rest.

A ``Source`` gives a file's bytes or raises ``Refused``; an ``Extractor`` says which media types it
reads. ``register`` makes of both a table function that SQL calls laterally: it downloads with
retries, asks the first extractor that knows the media type, and cuts and measures the text. Nothing
that goes wrong with a file leaves its row: it says what went wrong.
"""

from __future__ import annotations

import json
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quarry.operators.analysis import FAILURES, NETWORK_FAULTS
from quarry.operators.chunking import OTHER, SIZES, pieces
from quarry.plans.fixtures import DOCX, PDF, PPTX, SLIDES
from quarry.sources.files import headings_of, slides_of
from quarry.sources.pdf import BrokenPdf, pages_of

#: Attempts of a download, and the wait before the second; it doubles each time.
ATTEMPTS, WAIT_S = 3, 0.5


class Refused(Exception):
    """A source does not give a file: a known reason or none, a status, a code of the network."""

    def __init__(self, reason: str | None = None, status: int | None = None, code: str | None = None):
        super().__init__(reason or code or f"status {status}")
        self.reason, self.status, self.code = reason, status, code

    def passing(self) -> bool:
        return self.status is not None and (self.status == 429 or self.status >= 500) or self.code in NETWORK_FAULTS


class Source(Protocol):
    def get(self, file_id: str, attempt: int, acknowledged: bool) -> bytes: ...


@dataclass(frozen=True)
class Extracted:
    """Sections (text, page, slide, title) of a file, and how many pages or slides it has."""

    sections: list[dict]
    pages: int | None = None
    slides: int | None = None


@dataclass(frozen=True)
class Extractor:
    """``read`` makes sections of the bytes of files with one of the media types."""

    types: tuple[str, ...]
    read: Callable[[bytes], Extracted]


def slides_of_json(data: bytes) -> Extracted:
    """Sections of a presentation as its service writes it."""
    slides = json.loads(data).get("slides") or []
    out = []
    for number, slide in enumerate(slides, 1):
        shapes = [e.get("shape") or {} for e in slide.get("pageElements") or []]
        said = ["".join((t.get("textRun") or t.get("autoText") or {}).get("content") or "" for t in ((s.get("text") or {}).get("textElements") or [])).strip() for s in shapes]
        titles = [t for s, t in zip(shapes, said, strict=True) if t and (s.get("placeholder") or {}).get("type") in ("TITLE", "CENTERED_TITLE")]
        if text := "\n".join(t for t in said if t):
            out.append({"text": text, "page": None, "slide": number, "title": titles[0] if titles else None})
    return Extracted(out, slides=len(slides))


def _pdf(data: bytes) -> Extracted:
    pages = pages_of(data)
    return Extracted([{"text": t, "page": k, "slide": None, "title": None} for k, t in enumerate(pages, 1) if t], pages=len(pages))


def _pptx(data: bytes) -> Extracted:
    sections, count = slides_of(data)
    return Extracted(sections, slides=count)


#: In the order in which they are asked.
EXTRACTORS = (Extractor((PDF,), _pdf), Extractor((PPTX,), _pptx), Extractor((SLIDES,), slides_of_json), Extractor((DOCX,), lambda data: Extracted(headings_of(data))))
_BROKEN = (zipfile.BadZipFile, KeyError, expat.ExpatError, BrokenPdf, ValueError, UnicodeDecodeError)


def structural(found: Extracted, kind: str) -> int | None:
    """What the extractor counted, else how many pages (slides) the sections name."""
    counted = found.pages if kind == "page" else found.slides
    named = {s[kind] for s in found.sections if s[kind] is not None}
    return counted if counted is not None else len(named) or None


def downloaded(source: Source, file_id: str, mime: str, acknowledge: bool, attempts: int = ATTEMPTS, wait_s: float = WAIT_S) -> tuple[bytes, int]:
    """A file's bytes and how many attempts it took. What may pass is tried again after a growing
    wait; a file that is held to be abusive once more with an acknowledgement, if it is a PDF and that is wanted."""
    for attempt in range(1, attempts + 1):
        try:
            try:
                data = source.get(file_id, attempt, False)
            except Refused as refused:
                if refused.reason != "cannotDownloadAbusiveFile" or mime != PDF or not acknowledge:
                    raise
                try:
                    data = source.get(file_id, attempt, True)
                except Refused as again:
                    raise Refused("cannotDownloadAbusiveFile", again.status, again.code) from again
            if not data:
                raise ValueError("the file is empty")
            return data, attempt
        except Refused as refused:
            if attempt == attempts or not refused.passing():
                raise
            time.sleep(wait_s * 2 ** (attempt - 1))
    raise AssertionError("not reached")


_MEASURES = "status string, reason string, error string, attempts int, page_count int, slide_count int, extracted_characters long, extracted_bytes long, chunk_count long, chunk_text_characters long, chunk_text_payload_bytes long, metadata_payload_bytes long"
_SECTIONS = "sections array<struct<text:string,page:int,slide:int,title:string>>"


def analysed(source: Source, extractors: tuple[Extractor, ...], file_id: str, mime: str, acknowledge: bool, wait_s: float) -> tuple[tuple, list[dict] | None]:
    """The measures of one file, and its sections."""
    def row(status: str, reason: str | None = None, error: object = None, attempts: int | None = None, **found: int | None) -> tuple:
        names = [c.split()[0] for c in _MEASURES.split(", ")][4:]
        return status, reason, None if error is None else str(error), attempts, *[found.get(n) for n in names]

    reader = next((e for e in extractors if mime in e.types), None)
    if reader is None:
        return row("unsupported", error=f"no extractor for {mime}"), None
    try:
        data, attempts = downloaded(source, file_id, mime, acknowledge, wait_s=wait_s)
    except Refused as refused:
        return row(FAILURES.get(refused.reason or "", "extraction_failed"), refused.reason if refused.reason in FAILURES else "unknown", refused), None
    except ValueError as broken:
        return row("extraction_failed", error=broken), None
    try:
        found = reader.read(data)
    except _BROKEN as broken:
        return row("extraction_failed", error=broken, attempts=attempts), None
    characters, size = sum(len(s["text"]) for s in found.sections), sum(len(s["text"].encode()) for s in found.sections)
    chunks = [(c, s) for s in found.sections for c in pieces(s["text"], *SIZES.get(mime, OTHER))]
    if not chunks:
        return row("empty_document", attempts=attempts, extracted_characters=characters, extracted_bytes=size, chunk_count=0), found.sections
    payload = 0
    for k, (content, section) in enumerate(chunks):
        record = {"id": f"{file_id}:{k}", "documentId": file_id, "chunkIndex": k, "content": content} | {n: section[n] for n in ("page", "slide", "title") if section[n] is not None}
        payload += max(0, len(json.dumps(record, ensure_ascii=False, separators=(",", ":")).encode()) - len(content.encode()))
    return row(
        "success", attempts=attempts, page_count=structural(found, "page"), slide_count=structural(found, "slide"), extracted_characters=characters, extracted_bytes=size, chunk_count=len(chunks),
        chunk_text_characters=sum(len(c) for c, _ in chunks), chunk_text_payload_bytes=sum(len(c.encode()) for c, _ in chunks), metadata_payload_bytes=payload), found.sections


class Given:
    """A source whose answers stand in the rows: the bytes of a file, and what goes wrong before they are
    given, one fault for each attempt: a status, a code or a reason; with ``+`` an
    acknowledgement helps."""

    def __init__(self, data: bytes | None, faults: list[str] | None):
        self.data, self.faults = data, faults or []

    def get(self, file_id: str, attempt: int, acknowledged: bool) -> bytes:
        fault = self.faults[attempt - 1] if attempt <= len(self.faults) else ""
        if fault and not (acknowledged and fault.endswith("+")):
            fault = fault.removesuffix("+")
            raise Refused(status=int(fault)) if fault.isdigit() else Refused(code=fault) if fault in NETWORK_FAULTS else Refused(reason=fault)
        return bytes(self.data or b"")


def register(spark: SparkSession, name: str, extractors: tuple[Extractor, ...] = EXTRACTORS, source: Callable[..., Source] = Given, wait_s: float = WAIT_S) -> None:
    """A table function ``name(file_id, mime, acknowledge, with_sections, ...)``: the further arguments make the
    source. ``with_sections`` is a constant: without it the function has no column of texts, so that a
    dry run carries none."""

    dry, full = StructType.fromDDL(_MEASURES), StructType.fromDDL(f"{_MEASURES}, {_SECTIONS}")

    class Analysis:
        def __init__(self, result: AnalyzeResult | None = None):
            self.wanted = result is None or "sections" in result.schema.names

        @staticmethod
        def analyze(file_id: AnalyzeArgument, mime: AnalyzeArgument, acknowledge: AnalyzeArgument, with_sections: AnalyzeArgument, *more: AnalyzeArgument) -> AnalyzeResult:
            if not with_sections.isConstantExpression:
                raise ValueError("with_sections must be a constant")
            for argument, kind in ((file_id, "string"), (mime, "string"), (acknowledge, "boolean")):
                if argument.dataType.simpleString() not in (kind, "void"):
                    raise ValueError(f"a {kind} is expected, not {argument.dataType.simpleString()}")
            return AnalyzeResult(full if with_sections.value else dry)

        def eval(self, file_id: str, mime: str, acknowledge: bool, with_sections: bool, *more: object) -> Iterator[tuple]:
            measures, sections = analysed(source(*more), extractors, file_id, mime or "", bool(acknowledge), wait_s)
            yield (*measures, [(s["text"], s["page"], s["slide"], s["title"]) for s in sections] if sections is not None else None) if with_sections else measures

    spark.udtf.register(name, F.udtf(Analysis))


def analyse(files: DataFrame, name: str = "analyse_file", acknowledge: bool = False, with_sections: bool = False, more: tuple[str, ...] = ("content", "faults")) -> DataFrame:
    """``files`` (id, mime, ...) with a status and measures for each, by a registered function."""
    arguments = ", ".join(["f.id", "f.mime", str(acknowledge).lower(), str(with_sections).lower(), *(f"f.{c}" for c in more)])
    kept = ", ".join(f"f.{c}" for c in files.columns if c not in more)
    return files.sparkSession.sql(f"SELECT {kept}, a.* FROM {{files}} f, LATERAL {name}({arguments}) a", files=files)
