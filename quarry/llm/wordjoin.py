"""Candidates of a Jaccard join of word multisets, by prefixes in order of rarity.

Single words make poor stars: the lines that share one rare word are mostly unrelated, and
over such words all lines of a corpus hang together. So the records that share a prefix token
are compared in pairs, under the length filter, the positional filter and a bitmap filter:
the sketch of a set is the parity of its tokens in each of 128 places, and two sets differ in
at least as many tokens as their sketches do in places. Only pairs that may still link are
edges. No pair that links is lost: it passes all three at its first common token.

Any order of tokens will do, as long as it is the same everywhere. Words are ordered by
classes of how often they come in the whole corpus, then by hash. The counts are those of
hash buckets, a table of fixed size: words that share a bucket share its class.

Postings travel packed: tokens by their 48-bit hashes, sorted, as differences; sets by their
sketches, or, where these have too few bits to tell sets apart, by a hash. Tokens that share a
hash, and sets that share a name, only add to what is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import lean, mix, pack, partitions, slices, unpack
from quarry.llm.components import forest
from quarry.llm.setjoin import PERCENT, SHARDS, runs
from quarry.llm.tokens import hashed, words

#: Hash buckets whose words are counted together: 16 MiB of classes, whatever the input.
BUCKET_BITS = 24
#: The counts travel in so many parts.
PARTS = 16
#: Smaller sets link only with equal ones.
LEAST = 4
#: Smaller sets are named by the hash of their tokens, others by their sketch.
NAMED = 16
#: Words of the corpus for each shard of postings, about 64 MB of them.
WORDS_PER_SHARD = 6_000_000
#: The four bits of a token that hold its class; bits of a posted token.
CLASS, TOKEN_BITS = np.uint64(0xF << 60), 48


@dataclass(frozen=True)
class Rarity:
    """The class of each bucket, packed, and the number of words in the corpus."""

    packed: bytes
    words: int

    def classes(self) -> np.ndarray:
        return _unpacked(self.packed)

    def shards(self, least: int) -> int:
        return max(SHARDS * least, -(-self.words // WORDS_PER_SHARD))


@lru_cache(1)
def _unpacked(packed: bytes) -> np.ndarray:
    return unpack(packed, np.uint8, 1 << BUCKET_BITS)


def rarity(rows: DataFrame, text_col: str = "text") -> Rarity:
    """The bit length (15 at most) of each bucket's count over all ``rows``."""
    each = (1 << BUCKET_BITS) // PARTS
    schema = "part int, words long, counts binary"

    def batch(rows_: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows_], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["part", "words", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(1 << BUCKET_BITS, np.uint32), 0
        for part in slices(batches):
            _, index, dictionary = words(part.column(0))
            if len(index):
                np.add.at(seen, (hashed(dictionary) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.bincount(index, minlength=len(dictionary)).astype(np.uint32))
                total += len(index)
        if total:
            own = np.minimum(seen, 65535).astype(np.uint16).reshape(PARTS, each)
            for part, counts in enumerate(own):
                yield batch([(part, 0 if part else total, pack(counts))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        total = 0
        for found in batches:
            for part, many, raw in zip(*(c.to_pylist() for c in found.columns), strict=True):
                sums[part] = sums.get(part, 0) + unpack(raw, np.uint16, each).astype(np.int64)
                total += many
        yield batch([(part, 0 if k else total, pack(np.minimum(np.frexp(x)[1], 15).astype(np.uint8))) for k, (part, x) in enumerate(sums.items())])

    out, total = np.zeros((PARTS, each), np.uint8), 0
    for row in rows.select(text_col).mapInArrow(lean(count), schema).repartition(PARTS, "part").mapInArrow(lean(add), schema).collect():
        out[row.part] = unpack(row.counts, np.uint8, each)
        total += row.words
    return Rarity(pack(out.reshape(-1)), total)


def ordered(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Word hashes as tokens that sort by class first."""
    return classes[hashes >> np.uint64(64 - BUCKET_BITS)].astype(np.uint64) << np.uint64(60) | hashes >> np.uint64(4)


def sketches(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two words of parities for the sets that start at ``starts``."""
    if not len(starts):
        return np.zeros((0, 2), np.uint64)
    bit = np.uint64(1) << (tokens & np.uint64(63))
    high = tokens & np.uint64(64) > 0
    return np.stack([np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), starts) for x in (~high, high)], axis=1)


def pairs(tokens: np.ndarray, rids: np.ndarray, sizes: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all records that share a token, each at its place in the prefix, and
    may link; a pair that is connected already is passed over."""
    order = np.lexsort((sizes, tokens))
    tokens, rids, sizes, places, low, high = (x[order] for x in (tokens, rids, sizes.astype(np.int64), places, low, high))
    starts = runs(tokens, sizes)
    length = np.diff(np.append(starts, len(tokens)))
    end = np.repeat(starts + length, length)
    nodes, label = np.unique(rids, return_inverse=True)
    found, pending, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [], 0
    here, step = np.arange(len(tokens)), 1
    while len(here):
        here = here[here + step < end[here]]
        here = here[100 * sizes[here] >= PERCENT * sizes[here + step]]  # sizes ascend: out of reach for good
        x = here[label[here] != label[here + step]]
        y = x + step
        need = -(-PERCENT * (sizes[x] + sizes[y]) // (100 + PERCENT))
        ok = np.minimum(sizes[x] - places[x], sizes[y] - places[y]) >= need
        x, y, need = x[ok], y[ok], need[ok]
        ok = np.bitwise_count(low[x] ^ low[y]).astype(np.int64) + np.bitwise_count(high[x] ^ high[y]) <= sizes[x] + sizes[y] - 2 * need
        if ok.any():
            pending.append((label[x[ok]], label[y[ok]]))
            waiting += int(ok.sum())
        if pending and (step & (step - 1) == 0 or waiting > 100_000):
            a, b = forest(*map(np.concatenate, zip(*pending, strict=True)))
            found.append((nodes[a], nodes[b]))
            new = np.arange(len(nodes))
            new[b] = a
            label, pending, waiting = new[label], [], 0
            one = np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)
            here = here[~np.repeat(one, length)[here]]
        step += 1
    if pending:
        a, b = forest(*map(np.concatenate, zip(*pending, strict=True)))
        found.append((nodes[a], nodes[b]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


#: Rows of packed arrays for the shards: what they are depends on ``kind``.
PACKED = "kind int, shard int, many int, a binary, b binary, c binary, d binary, e binary, f binary"
POSTINGS, LINES, AGAIN = 0, 1, 2
_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each 32-bit hash, ascending with it."""
    return (hashes * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def rows_of(kind: int, shard: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """``columns`` (six at most), which lie sorted by shard, cut up by it. 64-bit hashes are stored
    as they are, since nothing makes them smaller; numbers are packed."""
    found, at = np.unique(shard, return_index=True)
    ends = np.append(at[1:], len(shard))

    def binary(column: np.ndarray) -> pa.Array:
        raw = column.dtype == np.uint64
        return pa.array([column[a:b].tobytes() if raw else pack(column[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary())

    heads = [pa.array([kind] * len(found), pa.int32()), pa.array(found.astype(np.int32)), pa.array((ends - at).astype(np.int32))]
    blank = [pa.nulls(len(found), pa.binary())] * (6 - len(columns))
    return pa.RecordBatch.from_arrays([*heads, *map(binary, columns), *blank], names=_NAMES)


def names(sizes: np.ndarray, sketch: np.ndarray, node: np.ndarray) -> np.ndarray:
    """What a set is called as a node: equal for equal sets."""
    with np.errstate(over="ignore"):
        own = mix(mix(sketch[:, 0]) + sketch[:, 1] * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64))
    return np.where(sizes < NAMED, node, own)


def postings(tokens: np.ndarray, sizes: np.ndarray, places: np.ndarray, sketch: np.ndarray, node: np.ndarray, shards: int) -> pa.RecordBatch:
    """Rows of postings. Each token is what it exceeds the one before it in its row by; ``node`` is
    sent of small sets only."""
    short = mix(tokens) >> np.uint64(64 - TOKEN_BITS)
    order = np.argsort(short)
    short, sizes, node = short[order], sizes[order], node[order]
    shard = shard_of(short >> np.uint64(TOKEN_BITS - 32), shards)
    step = np.diff(short, prepend=np.uint64(0)).astype(np.int64)
    new = np.flatnonzero(np.diff(shard, prepend=-1))
    step[new] = short[new].astype(np.int64)
    out = rows_of(POSTINGS, shard, [step, sizes, places[order], sketch[order].reshape(-1, 2)])
    ends = np.append(new[1:], len(shard))
    small = [node[a:b][sizes[a:b] < NAMED].tobytes() for a, b in zip(new.tolist(), ends.tolist(), strict=True)]
    return out.set_column(out.schema.get_field_index("e"), "e", pa.array(small, pa.binary()))


_POSTED = (np.int64, np.int32, np.int32)


def posted(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """(tokens, names, sizes, places, sketches) of the rows (many, a, b, ...) of a shard."""
    parts = []
    for many, *raw in rows:
        steps, sizes, places = (unpack(x, kind, many) for x, kind in zip(raw, _POSTED, strict=False))
        sketch, node = np.frombuffer(raw[3], np.uint64).reshape(many, 2), np.zeros(many, np.uint64)
        node[sizes < NAMED] = np.frombuffer(raw[4], np.uint64)
        parts.append((np.cumsum(steps).astype(np.uint64), names(sizes, sketch, node).view(np.int64), sizes, places, sketch))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(kind, its rows) of each shard; the rows come sorted by shard and kind."""
    now, held = None, []
    for batch in batches:
        for kind, shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (kind, shard) != now and held:
                yield now[0], held
                held = []
            now = (kind, shard)
            held.append(tuple(row))
    if held:
        yield now[0], held


def dealt(described: DataFrame, shards: int) -> DataFrame:
    """A task for every few shards."""
    return described.repartition(max(partitions(described.sparkSession), shards // SHARDS), "shard").sortWithinPartitions("shard", "kind")
