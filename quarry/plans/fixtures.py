"""Derived views over the driver tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

# Media types of the five supported formats, and of folders.
PDF = "application/pdf"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
SLIDES = "application/vnd.google-apps.presentation"
DOCS = "application/vnd.google-apps.document"

#: A file listing: every document is a file; even and odd neighbours share name and folder.
FILES = f"""
SELECT doc_id, 'f' || lpad(CAST(doc_id AS STRING), 7, '0') AS id,
  'doc' || CAST(doc_id - doc_id % 2 AS STRING) AS base,
  'doc' || CAST(doc_id - doc_id % 2 AS STRING) || CASE WHEN doc_id % 2 = 0 THEN '.pdf' WHEN doc_id % 8 = 1 THEN '.pptx'
    WHEN doc_id % 8 = 5 THEN '.docx' ELSE '' END AS name,
  CASE WHEN doc_id % 17 = 0 THEN 'image/png' WHEN doc_id % 2 = 0 THEN '{PDF}' WHEN doc_id % 8 = 1 THEN '{PPTX}'
    WHEN doc_id % 8 = 3 THEN '{SLIDES}' WHEN doc_id % 8 = 5 THEN '{DOCX}' ELSE '{DOCS}' END AS mime,
  'folder' || CAST((doc_id - doc_id % 2) % 20 AS STRING) AS parent, n_chars AS size, text
FROM {{documents}}"""

CATEGORY = f"""CASE mime WHEN '{PDF}' THEN 'PDF' WHEN '{PPTX}' THEN 'PPTX' WHEN '{SLIDES}' THEN 'Google Slides'
  WHEN '{DOCX}' THEN 'DOCX' WHEN '{DOCS}' THEN 'Google Docs' ELSE 'Other' END"""
SUPPORTED = f"mime IN ('{PDF}', '{PPTX}', '{SLIDES}', '{DOCX}', '{DOCS}')"
#: Chunks a file is expected to give, from its size alone.
ESTIMATE = f"CAST(greatest(1, CASE WHEN mime IN ('{PPTX}', '{SLIDES}') THEN ceil(size / 80000.0) ELSE ceil(size / 3.0 / 800) END) AS BIGINT)"

#: Pairs of a PDF and the PPTX of the same name and folder: the PPTX is kept.
PAIRS = f"""
SELECT p.id AS pdf_id, min(s.id) AS kept_id FROM files p JOIN files s ON p.base = s.base AND p.parent = s.parent
WHERE p.mime = '{PDF}' AND s.mime = '{PPTX}' GROUP BY p.id"""

CHUNKS = """
SELECT 'd' || CAST(CAST(floor(vec_id / 5) AS BIGINT) AS STRING) AS document_id, vec_id % 5 AS chunk_index, vec_id, embedding, label FROM {embeddings}"""


def snapshot(which: str) -> str:
    """The listing before (old) and after (new) a change: some files come, go or are edited."""
    left, shift = (9, 0) if which == "old" else (8, 1)
    return f"""
SELECT id, mime, size, doc_id, 'c' || CAST(CASE WHEN doc_id % 7 = 0 THEN doc_id + {shift} ELSE doc_id END AS STRING) AS modified
FROM files WHERE doc_id % 10 <> {left}"""
