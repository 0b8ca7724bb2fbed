"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters of the
lower-cased text, words padded by one blank), most frequent first, ties by length and code points. A
text is given the language whose profile has the least out-of-place distance: for each of
the text's own most frequent n-grams the difference of its two ranks, or the length of the
profile where it lacks the n-gram. Ties go to the language first in order.

The score is 1 - distance / greatest possible distance. Null texts and texts without a
letter are ``und`` with score 0, also if there is no profile at all. Rows with a null
language teach nothing. Repeated rows count as often as they occur. Very long texts are taken
whole; an empty table gives an empty result; other columns are ignored, or handed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import crc_remainder, lean, remainder, slices, small_batches, table, texts

#: N-grams of a language's profile and of a text's own list.
PROFILE, OWN = 400, 300
UNDETERMINED = "und"
#: The code point around words.
BLANK = 32
Profiles = list[tuple[str, np.ndarray, np.ndarray]]


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> np.ndarray:
    """Codes of all letter n-grams of a text, in no order: their code points, 21 bits each. The
    blank has its own, so that a letter is another n-gram than the same letter after a blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate(([BLANK], np.where(letter, codes, BLANK), [BLANK])).astype(np.int64)
    codes = codes[np.concatenate(([True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)))]
    two = (codes[:-1] << 21) | codes[1:]
    three = (two[:-1] << 21) | codes[2:]
    return np.concatenate((codes[codes != BLANK], two, three[codes[1:-1] != BLANK]))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def most_frequent(keys: np.ndarray, most: int) -> np.ndarray:
    """The most frequent keys, ties by key: shorter n-grams first, then by code points."""
    found, n = counted(keys)
    return found[np.argsort(-n, kind="stable")[:most]]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> Profiles:
    """A profile of each language, from all rows with a language. What reaches the driver
    is ``profile`` n-grams for each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in slices(batches, 200):
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            every = [grams(x) for x in texts(batch.column(0))]
            for lang in set(langs):
                mine = [g for g, x in zip(every, langs, strict=True) if x == lang]
                held.setdefault(lang, []).append(counted(np.concatenate(mine)))
                if len(held[lang]) > 8:
                    held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select(text_col, F.col(lang_col).cast("string")).filter(F.col(lang_col).isNotNull())
    counts = rows.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= profile).toPandas()
    out = []
    for lang, part in sorted(top.groupby("lang"), key=lambda x: x[0]):
        keys = part.sort_values("rank")["gram"].to_numpy(dtype=np.int64)
        order_ = np.argsort(keys)
        out.append((lang, keys[order_], order_))
    return out


def predict(text: str, profiles: Profiles, profile: int = PROFILE, own: int = OWN) -> tuple[str, float]:
    mine = most_frequent(grams(text), own)
    if not len(mine) or not profiles:
        return UNDETERMINED, 0.0
    best, least = UNDETERMINED, None
    for lang, keys, ranks in profiles:
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        apart = np.where(keys[at] == mine, np.minimum(np.abs(ranks[at] - np.arange(len(mine))), profile), profile)
        distance = int(apart.sum())
        if least is None or distance < least:
            best, least = lang, distance
    return best, 1.0 - least / (profile * len(mine))


def taught(docs: DataFrame, modulus: int = 4, out: int = 2) -> DataFrame:
    """The rows to learn from."""
    return docs.filter(crc_remainder("doc_id", modulus) != out)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(taught(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [predict(x, profiles) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(remainder(batch.column(0), 4) == 2), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text has no letter or shares no n-gram with any profile."""
    columns, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [predict(x, profiles) for x in texts(batch.column(at))]
            yield batch.filter(pa.array([lang != UNDETERMINED and score > 0 for lang, score in found], pa.bool_()))

    return docs.select(*columns).mapInArrow(lean(run), docs.schema)
