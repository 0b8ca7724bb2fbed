"""Scalar expressions on columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts see it: ASCII blanks, no-break and ideographic space, and others.
WHITE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, f"^{WHITE}+|{WHITE}+$", "")


def collapsed(col: Column) -> Column:
    """Runs of white space as one blank, ends trimmed: the key of a query cache."""
    return F.regexp_replace(trimmed(col), f"{WHITE}+", " ")


def fnv1a(col: Column) -> Column:
    """FNV-1a, 32 bits unsigned, over the UTF-16 units of a string."""
    units = F.regexp_extract_all(F.hex(F.encode(col, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    codes = F.transform(units, lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is zero; empty vectors, vectors of unequal length, and
    such with a number that is not finite, are an error."""
    squares = dot(a, a) * dot(b, b)
    value = F.when(squares == 0, F.lit(0.0)).when(squares < float("inf"), dot(a, b) / F.sqrt(squares))
    value = F.coalesce(value, F.raise_error(F.lit("a vector is not finite")).cast("double"))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value).otherwise(F.raise_error(F.lit("vectors of unequal length, or empty")).cast("double"))


def normalised(v: Column) -> Column:
    """A vector of length 1; an empty one, zero, or one that is not finite, is an error."""
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.raise_error(F.lit("zero vector, or not finite")).cast("array<double>"))


def preview(col: Column, most: int = 320) -> Column:
    flat = collapsed(col)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def search_text(name: Column, title: Column, content: Column) -> Column:
    return F.concat_ws("\n", *(F.nullif(c, F.lit("")) for c in (name, title, content)))


def token_estimate(col: Column) -> Column:
    return F.octet_length(col) + 16


def mention_query(text: Column, bot: str) -> Column:
    """The text without mentions of the bot; without any, one leading mention of anyone goes."""
    own = F.regexp_replace(text, f"<@{bot}(\\|[^>]+)?>", " ")
    return collapsed(F.when(own != text, own).otherwise(F.regexp_replace(text, f"^{WHITE}*<@[A-Z0-9]+(\\|[^>]+)?>", " ")))


def folder_url(prefix: str, folder: Column) -> Column:
    return F.concat(F.lit(prefix), F.replace(F.url_encode(folder), F.lit("+"), F.lit("%20")))


def bytes_label(n: Column) -> Column:
    """A number of bytes in the largest unit below it, with 0, 1, 1 and 2 decimals."""

    def scaled(power: int, digits: int, unit: str) -> Column:
        # A tie goes up, as a reader expects; decimals keep the digits exact.
        value = F.round((n / F.lit(1024.0**power)).cast("decimal(30,10)"), digits).cast(f"decimal(30,{digits})")
        return F.concat(value.cast("string"), F.lit(f" {unit}"))

    return F.when(n < 1024, scaled(0, 0, "B")).when(n < 1024**2, scaled(1, 1, "KiB")).when(n < 1024**3, scaled(2, 1, "MiB")).otherwise(scaled(3, 2, "GiB"))


# Names of the kinds of score.
SCORE_NAMES = {"reranker": "Reranker関連度", "rrf": "RRF統合スコア", "cosine": "コサイン類似度"}
OTHER_SCORE = "関連度"


def score_label(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SCORE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, kind), F.lit(OTHER_SCORE))


def display_score(score: Column, kind: Column) -> Column:
    """A score as a share of the most its kind can be, from 0 to 1; what is not finite is 0."""
    share = score / F.when(kind == "rrf", F.lit(2 / 61)).otherwise(F.lit(1.0))
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).otherwise(0.0)


def location_label(page: Column, slide: Column, section: Column) -> Column:
    """The page, else the slide, else the section of a result."""
    return F.coalesce(F.concat(F.lit("Page "), page.cast("string")), F.concat(F.lit("Slide "), slide.cast("string")), section)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def chat_escaped(text: Column) -> Column:
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return text


def document_format(name: Column, mime: Column) -> Column:
    """PDF, SLIDES or DOC by media type or name, else FILE."""
    kinds = (("PDF", "pdf", ".pdf"), ("SLIDES", "presentation", ".pptx"), ("DOC", "document", ".docx"))
    name, mime = F.lower(name), F.lower(F.coalesce(mime, F.lit("")))
    return F.coalesce(*[F.when(mime.contains(part) | name.endswith(end), label) for label, part, end in kinds], F.lit("FILE"))


def document_id(path: Column, content: Column) -> Column:
    return F.concat(F.lit("document-"), F.left(F.sha2(F.concat(path, F.lit("\0"), content), 256), F.lit(16)))


def embedding_input(title: Column, content: Column) -> Column:
    """What is embedded of a chunk: the line of its section's title, if any, and its text."""
    return F.concat_ws("\n", F.nullif(title, F.lit("")), content)


def percent_encoded(text: Column) -> Column:
    """As a part of an address: UTF-8 bytes, with blanks as %20 and five marks as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def descriptor_value(text: Column, key: str) -> Column:
    """The decoded value of ``key`` in a list of key=value parts; null where there is none."""
    found = F.filter(F.split(text, ";"), lambda part: part.startswith(f"{key}="))
    return F.url_decode(F.replace(F.substring(F.try_element_at(found, F.lit(1)), len(key) + 2, 1 << 30), F.lit("+"), F.lit("%2B")))


def csv_value(value: Column) -> Column:
    """A cell: quoted where it holds a quote, a comma or a line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\\n\\r]'), quoted).otherwise(text)
