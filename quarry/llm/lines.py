"""Line dedup: an exact set-similarity join of all lines, later matches removed.

A line's tokens are its words, repeats numbered, in order of rarity. ``wordjoin`` finds the
lines that share a prefix token and pass the length, positional and bitmap filters, and each
task joins its lines by PPJoin: prefix index, length filter, positional filter, then the exact
Jaccard similarity, 0.8 or more.

A line is removed if an earlier line, by (doc_id, line number), is equal in tokens or
similar to it, whether that one is kept or not. Lines without words are kept. Null text is
empty. Each row is a document of its own, with its own result: rows that share an id, or have
none, come after all others, by id (null last) and text. Rows whose text loses all its lines
keep the empty text, and ``dedup`` drops them. Very long texts are taken whole, a slice of rows
at a time; an empty table gives an empty result; other columns are ignored, or handed on by ``dedup``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import wordjoin
from quarry.llm.common import bitmap, fresh, in_bitmap, lean, mix, partitions, slices, small_batches, spill, table, unpack
from quarry.llm.components import components, forest
from quarry.llm.setjoin import POSTINGS_AT_ONCE, first_number, links, met, needed, prefix_size, tasks
from quarry.llm.tokens import compact, word_hashes
from quarry.llm.wordjoin import AGAIN, LEAST, LINES, PACKED, POSTINGS

#: From here on are the keys of rows that share an id or have none.
_SHARED = (1 << 63) - (1 << 60)
#: Lines that a task holds before it sends them.
LINES_AT_ONCE = 200_000


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all lines, the number of each one's text, its number in the text)."""
    split = pc.split_pattern(compact(texts), "\n")
    bounds = split.offsets.to_numpy().astype(np.int64)
    per_text = np.diff(bounds)
    lines = split.values.slice(bounds[0], bounds[-1] - bounds[0])
    return lines, np.repeat(np.arange(len(texts)), per_text), np.arange(len(lines)) - np.repeat(bounds[:-1] - bounds[0], per_text)


def place_hash(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A hash of (document, line number), the same in all tasks."""
    with np.errstate(over="ignore"):
        return mix(mix(doc.astype(np.uint64)) + number.astype(np.uint64)).view(np.int64)


class WordLines:
    """The multisets of words of an array of lines, in flat arrays: a word's second, third, ...
    place in its line are tokens of their own, which follow the first in order."""

    def __init__(self, flat: pa.Array, classes: np.ndarray):
        offsets, hashes = word_hashes(flat)
        many = np.diff(offsets)
        key = wordjoin.ordered(hashes, classes)
        order = np.argsort(many, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(many[order])) + 1):  # lines of as many words
            if len(rows) and many[rows[0]] > 1:
                at = offsets[rows][:, None] + np.arange(many[rows[0]])
                key[at] = np.sort(key[at], axis=1)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.lines = np.flatnonzero(many > 0)  # lines with words
        self.start, self.size = offsets[:-1][self.lines], many[self.lines]
        new[self.start] = True
        first = np.flatnonzero(new)
        times = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        with np.errstate(over="ignore"):
            again = key & wordjoin.CLASS | mix(key + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(4)
        self.key = np.where(new, key, again)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit signatures of each line's set."""
        if not len(self.start):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            one = np.add.reduceat(mix(self.key), self.start)
            two = np.add.reduceat(mix(self.key ^ np.uint64(0x5851F42D4C957F2D)), self.start)
        return mix(one), mix(two)

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, number of the set, place) of the prefix tokens."""
        size = np.where(self.size >= LEAST, prefix_size(self.size), 0)
        own = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        return self.key[self.start[own] + place], own, place


def by_rarity(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets with tokens numbered by how many of the sets have them, rarest first."""
    codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return [np.sort(x) for x in np.split(rank[codes], np.cumsum([len(x) for x in sets])[:-1])]


def ppjoin(sets: list[np.ndarray], order: list) -> list[int]:
    """Numbers of the sets that link to one that comes earlier in ``order``."""
    index: dict[int, list[tuple[int, int]]] = defaultdict(list)
    whole: list[frozenset[int]] = [frozenset(x.tolist()) for x in sets]
    later: list[int] = []
    for x in sorted(range(len(sets)), key=order.__getitem__):
        n, seen = len(sets[x]), set()
        prefix = sets[x][: int(prefix_size(n))].tolist()

        def earlier(x: int = x, n: int = n, seen: set[int] = seen, prefix: list[int] = prefix) -> bool:
            for i, token in enumerate(prefix):
                for y, j in index[token]:
                    if y in seen:
                        continue
                    seen.add(y)
                    m = len(whole[y])
                    if 100 * min(n, m) < 80 * max(n, m) or 1 + min(n - i - 1, m - j - 1) < needed(n, m):
                        continue
                    if links(n, m, len(whole[x] & whole[y])):
                        return True
            return False

        if earlier():
            later.append(x)
        for i, token in enumerate(prefix):
            index[token].append((x, i))
    return later


def _verify(rows: list[tuple]) -> list[tuple]:
    sets = by_rarity([np.frombuffer(r[4], dtype=np.uint64) for r in rows])
    return [rows[x][:2] for x in ppjoin(sets, [r[:2] for r in rows])]


def _sorted_sets(node: np.ndarray, check: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order by set and place, which rows in that order are the first of their set)."""
    order = np.lexsort((line, doc, check, node))
    new = np.ones(len(order), bool)
    new[1:] = (node[order[1:]] != node[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
    return order, new


def _describe(rarity: wordjoin.Rarity, shards: int):
    """Packed rows of three kinds: the postings of each set, the first line that has it, and the
    lines whose set comes earlier among those held."""

    def sent(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, check, n, doc, line, sketch, token, own, place = map(np.concatenate, zip(*held, strict=True))
        order, new = _sorted_sets(node, check, doc, line)
        first, again = order[new], order[~new]
        whole = np.zeros(len(order), bool)
        whole[first] = True
        some = np.flatnonzero(whole[own])
        if len(some):
            at = own[some]
            yield wordjoin.postings(token[some], n[at], place[some], sketch[at], node[at], shards)
        name = wordjoin.names(n, sketch, node)
        yield wordjoin.rows_of(LINES, wordjoin.shard_of(node[first] >> np.uint64(32), shards), [x[first] for x in (node, check, n, doc, line, name)])
        if len(again):
            yield wordjoin.rows_of(AGAIN, np.full(len(again), part % shards), [doc[again], line[again]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, part, held, lines_held, posted = rarity.classes(), first_number() >> 40, [], 0, 0
        for batch in slices(batches):
            flat, text, numbers = cut(batch.column(1))
            found = WordLines(flat, classes)
            if not len(found.lines):
                continue
            token, own, place = found.postings()
            doc = batch.column(0).to_numpy()[text[found.lines]]
            held.append((*found.sums(), found.size.astype(np.int32), doc, numbers[found.lines].astype(np.int32), wordjoin.sketches(found.key, found.start), token, own + lines_held, place.astype(np.int32)))
            lines_held, posted = lines_held + len(doc), posted + len(token)
            if posted >= POSTINGS_AT_ONCE or lines_held >= LINES_AT_ONCE:
                yield from sent(part, held)
                held, lines_held, posted = [], 0, 0
        if held:
            yield from sent(part, held)

    return run


_FOUND = "kind int, x long, y long, check long, n long, doc long, line int"


def _found(kind: int, **columns: np.ndarray) -> pa.RecordBatch:
    many = len(next(iter(columns.values())))
    types = {"kind": pa.int32(), "line": pa.int32()}
    names = [c.split()[0] for c in _FOUND.split(", ")]
    given = {"kind": np.full(many, kind, np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(given[c]) if c in given else pa.nulls(many, types.get(c, pa.int64())) for c in names], names=names)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (x, y) between the names of sets that may link; the first line of each set with its
    name (x) and hash (y); and the lines (doc, line) whose set has an earlier one."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for kind, rows in wordjoin.each_shard(batches):
        if kind == POSTINGS:
            tokens, called, sizes, places, sketch = wordjoin.posted(rows)
            more = wordjoin.pairs(tokens, called, sizes, places, sketch[:, 0], sketch[:, 1])
            a, b = forest(np.concatenate((a, more[0])), np.concatenate((b, more[1])))
        elif kind == LINES:
            hashes = [[np.frombuffer(r[k], np.int64) for k in (1, 2, 6)] for r in rows]
            places = [[unpack(x, t, r[0]) for x, t in zip(r[3:6], (np.int32, np.int64, np.int32), strict=True)] for r in rows]
            node, check, name, n, doc, line = (np.concatenate(x) for x in zip(*(a + b for a, b in zip(hashes, places, strict=True)), strict=True))
            order, new = _sorted_sets(node, check, doc, line)
            first, again = order[new], order[~new]
            yield _found(LINES, x=name[first], y=node[first], check=check[first], n=n[first].astype(np.int64), doc=doc[first], line=line[first])
            yield _found(AGAIN, doc=doc[again], line=line[again])
        else:
            for many, doc, line, *_ in rows:
                yield _found(AGAIN, doc=unpack(doc, np.int64, many), line=unpack(line, np.int32, many))
    yield _found(POSTINGS, x=a, y=b)


def _hashed(hash_of):
    """The hash (k) of each row's numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hash_of(*(c.to_numpy() for c in batch.columns)))], names=["k"])

    return lean(run)


def keyed(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a long that names each row, in the order of documents: the id, where it is one row's.
    Only the other rows are stored and numbered; a copy of a row comes after it."""
    own, listed, many = fresh(docs, "own", "listed", "many")
    rows = docs.withColumn(key, F.col(id_col).cast("long"))
    ids = rows.groupBy(F.col(key).alias(listed)).agg(F.count("*").alias(many))
    shared = spill(ids.filter((F.col(many) > 1) | F.col(listed).isNull() | (F.col(listed) >= _SHARED)).select(listed), "shared")
    if shared.isEmpty():
        return rows
    odd = rows.join(shared, F.col(key).eqNullSafe(F.col(listed)), "left_semi").withColumn(own, F.monotonically_increasing_id())
    order = [F.col(key).asc_nulls_last(), F.col(text_col).asc_nulls_first(), F.col(own)]
    numbered = odd.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.lit(_SHARED) + F.monotonically_increasing_id())
    return rows.join(shared, F.col(key).eqNullSafe(F.col(listed)), "left_anti").unionByName(spill(numbered.drop(own), "shared_rows"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lines): the numbers (from 0) of the lines to remove, for each id that has some. An id names
    one row (``keyed`` sees to that)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rarity = wordjoin.rarity(rows)
    shards = rarity.shards(partitions(spark))
    found = spill(wordjoin.dealt(rows.mapInArrow(lean(_describe(rarity, shards)), PACKED), shards).mapInArrow(lean(_join), _FOUND), "lines")
    near = spill(components(found.filter(f"kind = {POSTINGS}").select(F.col("x").alias("a"), F.col("y").alias("b"))), "near")
    named = bitmap(near, "node")

    def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(named, batch.column(0).to_numpy())))

    sets = found.filter(f"kind = {LINES}").select(F.col("x").alias("name"), F.col("y").alias("node"), "check", "n", "doc", "line")
    members = sets.mapInArrow(lean(connected), sets.schema).join(near.withColumnRenamed("node", "name"), "name")
    assigned = spill(tasks(members.drop("name")).drop("block"), "assigned")
    bits = bitmap(assigned.select("doc", "line").mapInArrow(_hashed(place_hash), "k long"), "k")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = rarity.classes()
        for batch in slices(batches):
            lines, text, numbers = cut(batch.column(1))
            doc = batch.column(0).to_numpy()[text]
            some = np.flatnonzero(in_bitmap(bits, place_hash(doc, numbers)))
            if not len(some):
                continue
            found = WordLines(lines.take(pa.array(some)), classes)
            node, check = found.sums()
            keys = [found.key[a : a + n].tobytes() for a, n in zip(found.start.tolist(), found.size.tolist(), strict=True)]
            at = some[found.lines]
            columns = (doc[at], numbers[at].astype(np.int32), node.view(np.int64), check.view(np.int64))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(keys, pa.binary())], names=["doc", "line", "node", "check", "keys"])

    key = ["doc", "line", "node", "check"]
    whole = rows.mapInArrow(lean(full), "doc long, line int, node long, check long, keys binary")
    similar = met(assigned.hint("merge"), whole, key, key, _verify, "doc long, line long").withColumn("line", F.col("line").cast("int"))
    gone = found.filter(f"kind = {AGAIN}").select("doc", "line").unionByName(similar)
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; ``n_chars`` follows the new text. Documents that
    lose all their lines go."""
    key, lost, parts = fresh(docs, "key", "lost", "parts")
    rows = keyed(docs, key)
    gone = removed_lines(rows, key).select(F.col("doc").alias(key), F.col("lines").alias(lost))
    joined = rows.join(gone, key, "left").withColumn(parts, F.when(F.col(lost).isNotNull(), F.split("text", "\n", -1)))
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))
    left = F.array_join(F.transform(places, lambda k: F.get(F.col(parts), k)), "\n")
    changed = joined.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return changed.filter(F.col(lost).isNull() | (F.trim("text") != "")).select(*docs.columns)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """A row for each document: its lines, how many go, and their numbers."""
    rows = keyed(table(spark, sf_dir, "documents"), "doc")
    lines = rows.select("doc", "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines"))
    out = lines.join(removed_lines(rows, "doc"), "doc", "left").withColumn("removed_lines", F.coalesce("lines", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), "removed_lines")
