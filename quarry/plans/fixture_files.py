"""Office files made from texts, for the queries on extraction: a page or slide for every 1,500
characters, a paragraph for every line."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from xml.sax.saxutils import escape

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.plans.fixtures import DOCX, PDF, PPTX, SLIDES

PAGE = 1500


def parts(text: str) -> list[str]:
    return [text[k : k + PAGE] for k in range(0, len(text), PAGE)]


def _zip(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def _plain(text: str) -> str:
    return escape("".join(c for c in text if c in "\t\n" or c >= " "))


def pptx(text: str) -> bytes:
    slides = {f"ppt/slides/slide{k}.xml": "<p:sld>" + "".join(f"<a:p><a:r><a:t>{_plain(line)}</a:t></a:r></a:p>" for line in part.split("\n")) + "</p:sld>" for k, part in enumerate(parts(text), 1)}
    return _zip(**{"[Content_Types].xml": "<Types/>"} | slides)


def docx(text: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{_plain(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    return _zip(**{"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>"})


def slides(text: str) -> bytes:
    made = [{"objectId": f"s{k}", "pageElements": [{"shape": {"text": {"textElements": [{"textRun": {"content": part}}]}}}]} for k, part in enumerate(parts(text), 1)]
    return json.dumps({"slides": made}).encode()


def pdf(text: str) -> bytes:
    """Characters are numbers of two bytes that the font's map explains; contents are compressed, and
    every second page's object lies in an object stream."""
    codes = {c: k for k, c in enumerate(sorted(set(text) - {"\n"}), 1)}
    hexed = {c: f"{k:04x}" for c, k in codes.items()}
    chars = "\n".join(f"<{hexed[c]}> <{c.encode('utf-16-be').hex()}>" for c in codes)
    cmap = f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(codes)} beginbfchar\n{chars}\nendbfchar"
    shown = parts(text)
    pages = range(4, 4 + 2 * len(shown), 2)
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {len(shown)} /Kids [{' '.join(f'{k} 0 R' for k in pages)}] /Resources << /Font << /F1 3 0 R >> >> >>"}
    last = 4 + 2 * len(shown)
    objects[3] = f"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode {last} 0 R >>"
    streams, packed = {last: cmap}, {}
    for k, part in zip(pages, shown, strict=True):
        page = f"<< /Type /Page /Parent 2 0 R /Contents {k + 1} 0 R >>"
        (packed if k % 4 else objects)[k] = page
        streams[k + 1] = "BT /F1 10 Tf 12 TL 20 800 Td " + " T* ".join(f"[<{''.join(hexed[c] for c in line)}>] TJ" for line in part.split("\n")) + " ET"
    heads, at = [], 0
    for k, body in packed.items():
        heads.append(f"{k} {at}")
        at += len(body) + 1
    first = " ".join(heads) + "\n"
    out = b"%PDF-1.5\n" + "".join(f"{k} 0 obj\n{body}\nendobj\n" for k, body in objects.items()).encode()
    held = {k: (body.encode("latin-1"), "") for k, body in streams.items()}
    if packed:
        held[last + 1] = ((first + "\n".join(packed.values())).encode(), f"/Type /ObjStm /N {len(packed)} /First {len(first)} ")
    for k, (body, about) in held.items():
        raw = zlib.compress(body)
        out += f"{k} 0 obj\n<< {about}/Length {len(raw)} /Filter /FlateDecode >>\nstream\n".encode() + raw + b"\nendstream\nendobj\n"
    return out + b"trailer\n<< /Root 1 0 R >>\n%%EOF\n"


MAKERS = {PDF: pdf, PPTX: pptx, DOCX: docx, SLIDES: slides}


def contents(mime: Column, text: Column) -> Column:
    """The bytes of a file of a media type with a text; null for types that are not made. Rows go to the workers
    by the hundred: an Arrow batch of 10,000 texts and their files would fill them."""
    make = F.udf(lambda kind, said: MAKERS[kind](said or "") if kind in MAKERS else None, "binary", useArrow=False)
    return make(mime, text)
