"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits (ASCII punctuation is blank, A-Z lower-cased). A pair
of document and item is looked at if they share seeds of ``LEAST`` words (the whole item,
if that is shorter), enough of them for the coverage asked for. Then the longest common runs of unmarked words are found by comparing
Karp-Rabin hashes of their windows, marked as tiles, and this is repeated until no run of
``LEAST`` words is left. Where equal windows of ``LEAST`` words would make too many pairs, longer
windows are tried first, which give the same longest runs. An item is found in a document if tiles cover ``COVERAGE`` of its
words, in whatever order they come.

The benchmark is taken in blocks of ``BLOCK_WORDS`` words; each block is sent to the tasks
and every document is read once for each block, without any shuffle. Null and empty texts
or items match nothing. Repeated documents and items each get their rows. Of equally long runs the
one comes first whose shift from item to text is least, then that earliest in the text. Very long
texts are taken whole; an empty table gives an empty result; other columns are ignored, or handed
on by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, slices, table
from quarry.llm.tokens import grams, plain, word_hashes

LEAST, COVERAGE, BLOCK_WORDS = 5, 0.5, 2_000_000
#: Pairs of equal windows that are laid out at once, about.
MOST_PAIRS = 1_000_000
_SEED_BITS = 22
#: The base of the window hashes, odd, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
Items = list[tuple[int, np.ndarray]]


class Windows:
    """Karp-Rabin hashes of the windows of a text, of any size, from running sums."""

    def __init__(self, words: np.ndarray):
        self.words, self.free = words, np.ones(len(words), bool)
        with np.errstate(over="ignore"):
            self.power, back = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(words), x, np.uint64)))) for x in (_BASE, _INVERSE))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * back[:-1], dtype=np.uint64)))

    def open(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows without a marked word."""
        marked = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(marked[size:] == marked[:-size])
        with np.errstate(over="ignore"):
            return at, (self.sums[at + size] - self.sums[at]) * self.power[at]


class Meeting:
    """Open windows of one size that an item and a text have in common, before they are paired."""

    def __init__(self, item: Windows, text: Windows, size: int):
        self.size = size
        at_item, keys = item.open(size)
        order = np.argsort(keys, kind="stable")
        self.item, keys = at_item[order], keys[order]
        self.text, asked = text.open(size)
        self.low = np.searchsorted(keys, asked, "left")
        self.many = np.searchsorted(keys, asked, "right") - self.low
        self.pairs = int(self.many.sum())

    def paired(self) -> tuple[np.ndarray, np.ndarray]:
        """(places in the item, places in the text) of windows with equal hashes."""
        return self.item[np.repeat(self.low - np.cumsum(self.many) + self.many, self.many) + np.arange(self.pairs)], np.repeat(self.text, self.many)


def _longest(item: Windows, text: Windows, least: int, most_pairs: float) -> Meeting:
    """Common windows of ``least`` words; if they make more than ``most_pairs`` pairs, as in texts
    that repeat themselves, of the greatest size needed, up to the longest match."""
    best, beyond = Meeting(item, text, least), min(len(item.words), len(text.words)) + 1
    while best.pairs > most_pairs and beyond - best.size > 1:
        tried = Meeting(item, text, min(2 * best.size, (best.size + beyond) // 2))
        if tried.pairs:
            best = tried
        else:
            beyond = tried.size
    return best


def tiles(words_of_item: np.ndarray, words_of_text: np.ndarray, least: int, most_pairs: float = MOST_PAIRS) -> list[tuple[int, int, int]]:
    """(place in item, place in text, words) of the tiles, longest first."""
    item, text, found, clash = Windows(words_of_item), Windows(words_of_text), [], False
    while True:
        common = _longest(item, text, least, float("inf") if clash else most_pairs)
        at_item, at_text = common.paired()
        for k in range(least if clash else 0):  # hashes only propose: word by word, once they have failed
            equal = words_of_item[at_item + k] == words_of_text[at_text + k]
            at_item, at_text = at_item[equal], at_text[equal]
        if not len(at_text):
            return found
        order = np.lexsort((at_text, at_text - at_item))
        at_text, at_item = at_text[order], at_item[order]
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(at_text) != 1) | (np.diff(at_item) != 1))))
        lengths = np.diff(np.append(starts, len(at_text))) + common.size - 1
        n = int(lengths.max())
        for s in starts[lengths == n]:
            i, t = int(at_item[s]), int(at_text[s])
            if item.free[i : i + n].all() and text.free[t : t + n].all():
                clash = not np.array_equal(words_of_item[i : i + n], words_of_text[t : t + n])
                if clash:
                    break
                item.free[i : i + n] = text.free[t : t + n] = False
                found.append((i, t, n))


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: Items, least: int = LEAST):
        self.items = [(k, h) for k, h in items if len(h)]
        self.least, seeds = least, {}
        for n, (_, hashes) in enumerate(self.items):
            size = min(least, len(hashes))
            found, times = np.unique(grams(hashes, size), return_counts=True)
            seeds.setdefault(size, []).append((found, np.full(len(found), n), times))
        self.seeds = {}
        for size, parts in seeds.items():
            keys, owner, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            some = np.zeros(1 << _SEED_BITS, bool)
            some[(keys >> np.uint64(64 - _SEED_BITS)).astype(np.int64)] = True
            self.seeds[size] = (keys[order], owner[order], times[order], some)
        self.sizes = np.array([len(h) for _, h in self.items], np.int64)

    def pairs(self, offsets: np.ndarray, hashes: np.ndarray, coverage: float = COVERAGE) -> Iterator[tuple[int, int]]:
        """(document's number, item's number) whose shared seeds leave room for ``coverage``: a tile
        of n words has n / size windows at least, so that they cover size words each at most."""
        hits = []
        for size, (keys, owner, times, some) in self.seeds.items():
            windows = grams(hashes, size)
            at = np.flatnonzero(some[(windows >> np.uint64(64 - _SEED_BITS)).astype(np.int64)])
            low = np.searchsorted(keys, windows[at], "left")
            many = np.searchsorted(keys, windows[at], "right") - low
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = (many > 0) & (at + size <= offsets[doc + 1])
            # each seed once for a document
            first = np.unique(np.stack((doc[inside], low[inside], many[inside])), axis=1) if inside.any() else np.zeros((3, 0), np.int64)
            hits.append((size, first, owner, times))
        for d in np.unique(np.concatenate([h[1][0] for h in hits])) if hits else ():
            near = []
            for size, (doc, low, many), owner, times in hits:
                a, b = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
                at = np.repeat(low[a:b] - np.cumsum(many[a:b]) + many[a:b], many[a:b]) + np.arange(many[a:b].sum())
                items, back = np.unique(owner[at], return_inverse=True)
                shared = np.bincount(back, weights=times[at], minlength=len(items))
                near += items[shared * size >= coverage * self.sizes[items]].tolist()
            yield from ((int(d), n) for n in sorted(near))

    def search(self, texts: pa.Array, coverage: float = COVERAGE) -> list[tuple[int, int, int, int, int, int, float]]:
        """(document's number, item id, its words, words covered, tiles, longest tile, coverage)."""
        offsets, hashes = word_hashes(plain(texts))
        out = []
        for d, n in self.pairs(offsets, hashes, coverage):
            key, item = self.items[n]
            found = tiles(item, hashes[offsets[d] : offsets[d + 1]], min(self.least, len(item)))
            covered = sum(x for _, _, x in found)
            if covered >= coverage * len(item):
                out.append((d, key, len(item), covered, len(found), max(x for _, _, x in found), covered / len(item)))
        return out


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark in blocks of at most ``most`` words (a longer item is a block)."""
    held: Items = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        _, hashes = word_hashes(plain(pa.array([row[1]], pa.large_string())))
        if held and size + len(hashes) > most:
            yield held
            held, size = [], 0
        held.append((row[0], hashes))
        size += len(hashes)
    yield held


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """A row for each document and item found in it."""
    names = ("item_words", "covered_words", "n_tiles", "longest_tile")

    def one(items: Items) -> DataFrame:
        index = Index(items, least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = index.search(batch.column(1), coverage)
                if found:
                    columns = list(zip(*found, strict=True))
                    ids = batch.column(0).take(pa.array(columns[0]))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:6]), pa.array(columns[6], pa.float64())],
                        names=["doc_id", "item_id", *names, "coverage"],
                    )

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, item_id long, " + ", ".join(f"{x} int" for x in names) + ", coverage double")

    return reduce(DataFrame.unionByName, map(one, blocks(benchmark)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """``docs`` without those in which an item is found."""
    at = docs.columns.index("text")
    for items in blocks(benchmark):
        index = Index(items, least)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in index.search(batch.column(at), coverage)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op3_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
