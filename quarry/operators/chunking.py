"""Overlapping chunks that end at natural boundaries, looked for in the last stretch of each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quarry.plans.fixtures import PDF, PPTX, SLIDES

#: How far back from the longest end a boundary is looked for, and from the overlap a blank.
LOOK_BACK, BLANK_BACK = 160, 40
# Chunk length and overlap by media type; any other has the last.
SIZES, OTHER = {PPTX: (1500, 100), SLIDES: (1500, 100), PDF: (900, 120)}, (900, 100)
# White space, what ends a sentence, and what may follow that.
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SENTENCE_ENDS, CLOSERS = ".!?。！？", "\"'”’）)"


def last_among(text: str, chars: str, low: int, high: int) -> int:
    """The last place in [low, high) with one of ``chars``, -1 if there is none."""
    return next((k for k in range(high - 1, low - 1, -1) if text[k] in chars), -1)


def end_of(text: str, low: int, high: int) -> int:
    """The best place in (low, high] to end a chunk: after a blank line, a line, a sentence or a
    blank, the last of its kind; else ``high``. Only the text between is looked at."""
    line = text.rfind("\n", low, high)
    at = line
    while at >= 0:
        other = text.rfind("\n", low, at)
        if other >= 0 and not text[other + 1 : at].strip(WHITE):
            return at + 1
        at = other
    if line >= 0:
        return line + 1
    sentence = last_among(text, SENTENCE_ENDS, low, high)
    if sentence >= 0:
        after = text[sentence + 1 : high].lstrip(CLOSERS).lstrip(WHITE)
        return high - len(after)
    white = last_among(text, WHITE, low, high)
    return white + 1 if white >= 0 else high


def start_of(text: str, low: int, high: int) -> int:
    """After the last blank in [low, high), else ``high``."""
    white = last_among(text, WHITE, low, high)
    return white + 1 if white >= 0 else high


def pieces(text: str, size: int = 900, overlap: int = 100) -> list[str]:
    """The chunks of a text: at most ``size`` characters, the next one starting about
    ``overlap`` before the end of the last."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, overlap in [0, size)")
    text = text.replace("\r\n", "\n").replace("\r", "\n").strip(WHITE)
    if len(text) <= size:
        return [text] if text else []
    spans, start = [], 0
    while start + size < len(text):
        end = end_of(text, max(start + 1, start + size - LOOK_BACK), start + size)
        spans.append((start, end))
        back = max(start + 1, end - overlap)
        start = start_of(text, max(start + 1, back - BLANK_BACK), back) if overlap else end
    spans.append((start, len(text)))
    return [x for x in (text[a:b].strip(WHITE) for a, b in spans) if x]


def chunk_documents(docs: DataFrame, size: int = 900, overlap: int = 100) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, content) of documents (doc_id, text); null has no chunks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, f"{i}:{k}", p) for i, t in zip(frame["doc_id"], frame["text"], strict=True) for k, p in enumerate(pieces(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk_id", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_index long, chunk_id string, content string")


SECTION_CHUNKS = "document_id string, chunk_index long, chunk_id string, content string, page int, slide int, section_title string"


def chunk_sections(files: DataFrame) -> DataFrame:
    """Chunks of extracted files (document_id, mime, sections), numbered through each file;
    page, slide and title come from the section. A null list of sections has no chunks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for document, mime, sections in zip(frame["document_id"], frame["mime"], frame["sections"], strict=True):
                found = [(p, s) for s in (sections if sections is not None else []) for p in pieces(s["text"] or "", *SIZES.get(mime, OTHER))]
                out += [(document, k, f"{document}:{k}", p, s["page"] or None, s["slide"] or None, s["title"] or None) for k, (p, s) in enumerate(found)]
            rows = pd.DataFrame(out, columns=["document_id", "chunk_index", "chunk_id", "content", "page", "slide", "section_title"])
            yield rows.astype({"page": "Int32", "slide": "Int32"})

    return files.select("document_id", "mime", "sections").mapInPandas(run, SECTION_CHUNKS)
