"""File listings and contents, and the sections of office documents and slides."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from itertools import accumulate, groupby
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import all_nfkc, tidied
from quarry.operators.chunking import WHITE
from quarry.plans.fixtures import DOCX, PDF, PPTX, SLIDES

SECTIONS = "path string, status string, sections array<struct<text:string,page:int,slide:int,title:string>>, slide_count int"
SLIDES_JSON = """struct<slides:array<struct<objectId:string,pageElements:array<struct<shape:struct<placeholder:struct<type:string>,
text:struct<textElements:array<struct<textRun:struct<content:string>,autoText:struct<content:string>>>>>>>>>>"""


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]", recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of the files; empty ones are left out."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.load(folder).filter("length > 0")


def write_index(chunks: DataFrame, path: str, provider: str, dimensions: int, parts: int = 16) -> None:
    """Replaces the index at ``path``: chunks (id, document_id, chunk_index, content, embedding) in ``parts``
    JSON documents, each an index of its own that holds the documents of one hash."""
    part = F.pmod(F.xxhash64("document_id"), F.lit(parts)).cast("int")
    one = F.struct("id", F.col("document_id").alias("documentId"), F.col("chunk_index").alias("chunkIndex"), "content", "embedding")
    whole = chunks.groupBy(part.alias("part")).agg(F.sort_array(F.collect_list(one)).alias("chunks"))
    named = whole.select(F.lit(1).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"), F.lit(provider).alias("embeddingProviderId"), F.lit(dimensions).alias("embeddingDimensions"), "chunks")
    named.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def local_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a JSON index with a stated schema; a malformed file is an error."""
    schema = "version int, embeddingProviderId string, embeddingDimensions int, chunks array<struct<id:string,documentId:string,chunkIndex:bigint,content:string,embedding:array<double>>>"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select("version", "embeddingProviderId", F.explode("chunks").alias("c")).select("version", "embeddingProviderId", "c.*")


#: A stored chunk as its service gives it: every field may be missing, numbers may be texts.
RECORD = """struct<id:string,documentId:string,documentName:string,chunkIndex:string,content:string,embedding:array<double>,
sourceModifiedTime:string,driveFileId:string,mimeType:string,page:string,slide:string,sectionTitle:string,url:string>"""
#: The largest whole number that a double holds exactly with all below it.
SAFE = 2**53 - 1


def _whole(col: Column) -> Column:
    value = F.when(col.rlike("^-?[0-9]+$"), col.try_cast("long"))
    return F.when(F.abs(value) <= SAFE, value)


def decode_entities(rows: DataFrame, column: str = "json") -> DataFrame:
    """Chunks of JSON records. A record without one of its five mandatory fields is an error;
    empty optional texts and numbers that are not whole are null; no vector is an empty one."""
    r = rows.select(F.from_json(column, RECORD).alias("r")).select("r.*")
    index = _whole(F.col("chunkIndex"))
    whole = index.isNotNull()
    for name in ("id", "documentId", "documentName", "content"):
        whole = whole & (F.coalesce(F.col(name), F.lit("")) != "")
    own = F.when(whole, F.col("id")).otherwise(F.raise_error(F.lit("a stored chunk lacks a mandatory field")).cast("string"))
    optional = {"source_modified_time": "sourceModifiedTime", "drive_file_id": "driveFileId", "mime_type": "mimeType", "section_title": "sectionTitle", "url": "url"}
    return r.select(
        own.alias("id"), F.col("documentId").alias("document_id"), F.col("documentName").alias("document_name"), index.alias("chunk_index"), "content",
        F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"), _whole(F.col("page")).alias("page"), _whole(F.col("slide")).alias("slide"),
        *[F.nullif(F.col(b), F.lit("")).alias(a) for a, b in optional.items()])


INDEX = "struct<version:int,embeddingProviderId:string,embeddingDimensions:int,chunks:array<struct<id:string,documentId:string,chunkIndex:bigint,content:string,embedding:array<double>>>>"


def parse_indexes(docs: DataFrame, column: str = "json") -> DataFrame:
    """The chunks of index documents held as JSON texts. One of another version, a chunk without
    id, document or content, or a vector of another length is an error."""
    parsed = docs.select(F.from_json(column, INDEX, {"mode": "FAILFAST"}).alias("x"))
    chunks = parsed.select(F.col("x.version").alias("version"), F.col("x.embeddingProviderId").alias("provider"), F.col("x.embeddingDimensions").alias("dimensions"), F.explode("x.chunks").alias("c"))
    ok = (F.col("version") == 1) & F.col("c.id").isNotNull() & F.col("c.documentId").isNotNull() & F.col("c.content").isNotNull() & (F.size("c.embedding") == F.col("dimensions")) & ~F.exists("c.embedding", lambda x: x.isNull() | F.isnan(x))
    own = F.when(ok, F.col("c.id")).otherwise(F.raise_error(F.lit("not a valid index")).cast("string"))
    return chunks.select(own.alias("id"), "provider", F.col("c.documentId").alias("document_id"), F.col("c.chunkIndex").alias("chunk_index"), F.col("c.content").alias("content"), F.col("c.embedding").alias("embedding"))


# The reasons that are told apart.
REASONS = ("cannotDownloadAbusiveFile", "exportSizeLimitExceeded", "insufficientFilePermissions", "fileNotDownloadable")


def classified(errors: DataFrame, body: str = "body", response: str = "response_status", direct: str = "direct_status") -> DataFrame:
    """``errors`` with status (of the response, else its own, else the body's code), reason (the
    first known one, else unknown) and whether another attempt may help."""
    error = F.from_json(body, "struct<error:struct<code:int,message:string,errors:array<struct<reason:string>>>>")["error"]
    status = F.coalesce(F.col(response), F.col(direct), error["code"])
    known = F.filter(error["errors"]["reason"], lambda r: r.isin(*REASONS))
    again = (status == 429) | status.between(500, 599)
    return errors.withColumns({"status": status, "reason": F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("unknown")), "retriable": F.coalesce(again, F.lit(False))})


class Paragraphs:
    """The paragraphs of an office document as a parser meets them: (style, its runs of text).
    Names are compared as they are written; without ``block`` the whole document is one."""

    def __init__(self, run: str, block: str | None = None, style: str | None = None):
        self.names, self.found, self.held = (run, block, style), [], None
        if block is None:
            self.found.append((None, []))

    def start(self, name: str, attributes: dict[str, str]) -> None:
        run, block, style = self.names
        if name == block:
            self.found.append((None, []))
        elif name == run and self.found:
            self.held = []
        elif name == style and self.found:
            self.found[-1] = (attributes.get("w:val"), self.found[-1][1])

    def text(self, data: str) -> None:
        if self.held is not None:
            self.held.append(data)

    def end(self, name: str) -> None:
        if name == self.names[0] and self.held is not None:
            said = unicodedata.normalize("NFKC", "".join(self.held)).strip(WHITE)
            self.held = None
            if said:
                self.found[-1][1].append(said)

    def read(self, xml: bytes) -> list[tuple[str | None, list[str]]]:
        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.text
        # a root of our own: parts of a document may come without one
        parser.Parse(b"<all>" + re.sub(rb"^\s*(?:\xef\xbb\xbf)?<\?xml[^>]*\?>", b"", xml) + b"</all>", True)
        return self.found


def slides_of(data: bytes) -> tuple[list[dict], int]:
    """Sections of a PPTX: a slide's texts by line, the first as its title."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = [(k, Paragraphs("a:t").read(z.read(n))[0][1]) for k, n in names]
    return [{"text": "\n".join(t), "page": None, "slide": k, "title": t[0]} for k, t in out if t], len(names)


# How the styles of headings start, in lower case.
HEADINGS = ("heading", "見出し")


def headings_of(data: bytes) -> list[dict]:
    """Sections of a DOCX, a new one at each heading; one of headings alone gives its last."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = Paragraphs("w:t", "w:p", "w:pStyle").read(z.read("word/document.xml"))
    said = [((style or "").lower().startswith(HEADINGS), "".join(runs)) for style, runs in found if runs]
    numbers = accumulate(heading for heading, _ in said)
    parts = [[x for _, x in group] for _, group in groupby(zip(numbers, said, strict=True), key=lambda x: x[0])]
    split = [(part[0][1] if part[0][0] else None, [text for heading, text in part if not heading]) for part in parts]
    titles = [title for title, _ in split if title]
    kept = [(title, "\n".join(body)) for title, body in split if body] or [(title, title) for title in titles[-1:]]
    return [{"text": text, "page": None, "slide": None, "title": title} for title, text in kept]


# Media types of each extractor, in their order.
EXTRACTORS = {"pdf": (PDF,), "pptx": (PPTX,), "slides": (SLIDES,), "docx": (DOCX,)}


def extractor_of(mime: Column) -> Column:
    """The first extractor for a content's media type, null if there is none."""
    return F.coalesce(*[F.when(mime.isin(*types), name) for name, types in EXTRACTORS.items()])


def structural_count(sections: Column, kind: str, counted: Column) -> Column:
    """What the extractor counted, else how many pages (slides) the sections name, else null."""
    named = F.size(F.array_distinct(F.filter(F.transform(sections, lambda s: s[kind]), lambda x: x.isNotNull())))
    return F.coalesce(counted, F.nullif(named, F.lit(0)))


def extract(files: DataFrame) -> DataFrame:
    """(path, status, sections, slide_count) of binary files; a file that cannot be read has a
    status of its own and stops nothing."""

    def one(path: str, data: bytes) -> tuple:
        try:
            if path.lower().endswith(".pptx"):
                sections, count = slides_of(bytes(data))
            elif path.lower().endswith(".docx"):
                sections, count = headings_of(bytes(data)), None
            else:
                return path, "unsupported", [], None
            return path, "success" if sections else "empty_document", sections, count
        except (zipfile.BadZipFile, KeyError, expat.ExpatError):
            return path, "failed", [], None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([one(p, c) for p, c in zip(frame["path"], frame["content"], strict=True)], columns=["path", "status", "sections", "slide_count"])
            yield out.astype({"slide_count": "Int64"})

    return files.select("path", "content").mapInPandas(run, SECTIONS)


def slides_json(docs: DataFrame, column: str = "json") -> DataFrame:
    """(slide, title, text) rows of presentations in JSON; empty slides are left out, counted."""
    slides = docs.select("*", F.posexplode(F.from_json(column, SLIDES_JSON)["slides"]).alias("pos", "s"))
    said = "transform(s.pageElements, e -> array_join(transform(e.shape.text.textElements, t -> coalesce(t.textRun.content, t.autoText.content, '')), ''))"
    plain = slides.withColumn("kinds", F.expr("transform(s.pageElements, e -> e.shape.placeholder.type)")).withColumn("texts", all_nfkc(F.expr(said)))
    shaped = F.transform(F.arrays_zip("kinds", "texts"), lambda x: F.struct(x["kinds"].alias("kind"), tidied(x["texts"]).alias("text")))
    shapes = plain.withColumn("shapes", F.filter(shaped, lambda x: x["text"] != ""))
    title = F.expr("try_element_at(filter(shapes, x -> x.kind IN ('TITLE', 'CENTERED_TITLE')), 1).text")
    return shapes.filter(F.size("shapes") > 0).select(*docs.columns, (F.col("pos") + 1).alias("slide"), title.alias("title"), F.array_join("shapes.text", "\n").alias("text"))
