"""Text functions that no built-in expresses, as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarry.functions.expressions import trimmed

# The named references of XML; the ampersand comes last.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
_DECIMAL, _HEX = re.compile(r"&#(\d+);"), re.compile(r"&#x([0-9a-f]+);", re.I)


def _char(match: re.Match, base: int) -> str:
    code = int(match[1], base)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else match[0]


def decode_xml(text: str) -> str:
    """Named references, then decimal and hexadecimal ones; one that is no character stays."""
    for name, char in NAMED:
        text = text.replace(name, char)
    return _HEX.sub(lambda m: _char(m, 16), _DECIMAL.sub(lambda m: _char(m, 10), text))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def xml_decoded(texts: pd.Series) -> pd.Series:
    return texts.map(decode_xml, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def all_nfkc(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ts: [unicodedata.normalize("NFKC", t or "") for t in ts], na_action="ignore")


def tidy(text: Column) -> Column:
    """NFKC, line ends as newlines, no blanks before them, at most one empty line, ends trimmed."""
    unix = F.regexp_replace(nfkc(text), "\\r\\n?", "\n")
    return _trimmed_lines(unix)


def tidied(text: Column) -> Column:
    """``tidy`` of a text that is in NFKC already."""
    return _trimmed_lines(F.regexp_replace(text, "\\r\\n?", "\n"))


def _trimmed_lines(unix: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(unix, "[ \\t]+\\n", "\n"), "\\n{3,}", "\n\n"))


def basename(name: Column) -> Column:
    """NFKC, without the last extension; a name that starts with its only dot keeps it."""
    return F.regexp_replace(nfkc(name), "^(.+)\\.[^.]*$", "$1")


@F.pandas_udf(StringType())
def _cut_utf8(texts: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.encode()[:n].decode(errors="ignore") for t, n in zip(texts, most, strict=True)])


def truncated_utf8(text: Column, most: int = 65535) -> Column:
    """At most ``most`` bytes of UTF-8, whole characters only."""
    return F.when(F.octet_length(text) <= most, text).otherwise(_cut_utf8(text, F.lit(most)))
