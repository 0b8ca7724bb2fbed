"""Exact Jaccard joins of token sets that never bring a token's whole list together with
the sets, nor all pairs of a group: what line dedup and the n-gram join share.

1. Every record posts an extended prefix of its tokens (in hash order) to the tokens'
   shards, which count the lists (of records whose sizes allow a link). Sets that link share
   at least l tokens of their extended prefixes (l grows with the set), so each record may
   leave out its l - 1 longest lists: whatever is left is in the order of true rarity, and
   linked sets still share one. Tokens that no other such record posted are done with.
2. The rarest shared tokens that a record has to keep are posted once more. A shard joins
   the records of one token whose sizes allow a link to the least of them, a star.
3. The components of those stars hold every link. Their full sets meet in tasks of bounded
   size: a component is one task, or, if large, is cut by size class and hash into blocks of
   which every two that can link are one task.

All postings travel packed, some rows for each task and shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, mix, pack, partitions, spill, unpack
from quarry.llm.components import components, forest

#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Tokens of one block, and postings a task holds before it sends them.
BLOCK_TOKENS, POSTINGS_AT_ONCE = 1_000_000, 500_000
#: Shards per shuffle partition, and the postings of one, about, beyond which there are more.
SHARDS, SHARD_POSTINGS = 2, 2_000_000


def first_number() -> int:
    """Where the records of this task start to be numbered."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 40


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    keep = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=keep[1:])
    return keys[keep]


def prefix_size(n):
    """Tokens of which two sets that link share one at least, in any order of all tokens."""
    return np.where(n > 0, n - -(-n * PERCENT // 100) + 1, 0)


def spare(n, eighths: int = 5):
    """Tokens more in the extended prefix, of which as many may be left out again. A function
    of the least overlap that grows no faster than it, as the proof needs."""
    return np.where(n > 0, (-(-n * PERCENT // 100) - 1) * eighths // 8, 0)


def runs(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where runs start in postings sorted by (token, size): one token, and each size within
    reach of the one before. Only records of one run can link by the token."""
    near = (tokens[1:] == tokens[:-1]) & (100 * sizes[:-1].astype(np.int64) >= PERCENT * sizes[1:].astype(np.int64))
    return np.flatnonzero(np.concatenate(([True], ~near)))


def signature(keys: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(keys.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def links(n: int, m: int, shared: int) -> bool:
    return 100 * shared >= PERCENT * (n + m - shared)


def needed(n: int, m: int) -> int:
    """The least overlap with which sets of n and m link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def _posted(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shards: int) -> pa.RecordBatch:
    """Postings (token, record, number), packed for the shards of their tokens."""
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    shard = (mix(columns[0]) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    found, at = np.unique(shard[order], return_index=True) if len(order) else (order, order)
    cut = [order[a:b] for a, b in zip(at, np.append(at[1:], len(order)), strict=False)]
    tokens, records, numbers = columns
    return pa.RecordBatch.from_arrays(
        [
            pa.array(found.astype(np.int32)),
            pa.array([len(c) for c in cut], pa.int32()),
            pa.array([tokens[c].tobytes() for c in cut], pa.binary()),
            pa.array([pack(records[c]) for c in cut], pa.binary()),
            pa.array([pack(numbers[c].astype(np.int32)) for c in cut], pa.binary()),
        ],
        names=["shard", "many", "tokens", "records", "numbers"],
    )


_POSTED = "shard int, many int, tokens binary, records binary, numbers binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, records, numbers) of each shard; the rows come sorted by shard."""
    now, parts = None, []

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    for batch in batches:
        for shard, many, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != now and parts:
                yield joined()
                parts = []
            now = shard
            parts.append((np.frombuffer(raw[0], np.uint64), unpack(raw[1], np.int64, many), unpack(raw[2], np.int32, many)))
    if parts:
        yield joined()


def shards_of(tasks_: int, tokens: int, eighths: int = 5) -> int:
    """Shards of the postings of sets with ``tokens`` tokens in all: some for each of ``tasks_`` at
    least, and as many as keep a shard, which a task holds whole, at about SHARD_POSTINGS."""
    share = (100 - PERCENT) + PERCENT * eighths // 8  # of 100 tokens, those in the extended prefix
    return SHARDS * max(tasks_, -(-tokens * share // (100 * SHARD_POSTINGS * SHARDS)))


def candidates(records: DataFrame, eighths: int = 5) -> DataFrame:
    """(node, component) of the records (rid long, n long, prefix binary) that may link; rows
    without a prefix are passed over. ``prefix`` holds the first prefix_size(n) + spare(n, eighths)
    tokens. Records may repeat a set: they are found to be linked. ``records`` should be stored:
    their sizes, which say how many shards there are, are summed first."""
    known = records.filter("prefix is not null")
    shards = shards_of(partitions(records.sparkSession), int(known.agg(F.sum("n")).first()[0] or 0), eighths)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            many = prefix_size(sizes) + spare(sizes, eighths)
            held.append((np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64), np.repeat(rids, many), np.repeat(sizes, many)))
            size += int(many.sum())
            if size >= POSTINGS_AT_ONCE:
                yield _posted(held, shards)
                held, size = [], 0
        if size:
            yield _posted(held, shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens that several records posted, with the length of the run."""
        held, size = [], 0
        for tokens, rids, sizes in _shards(batches):
            order = np.lexsort((sizes, tokens))
            tokens, rids, sizes = tokens[order], rids[order], sizes[order]
            length = np.diff(np.append(runs(tokens, sizes), len(tokens)))
            length = np.repeat(length, length)
            some = length > 1
            # lengths are only compared, so their logarithm in fine steps will do
            held.append((tokens[some], rids[some], np.log2(length[some]) * 1000, sizes[some]))
            size += len(held[-1][0])
            if size >= POSTINGS_AT_ONCE:
                yield _with_sizes(*map(np.concatenate, zip(*held, strict=True)), shards)
                held, size = [], 0
        if size:
            yield _with_sizes(*map(np.concatenate, zip(*held, strict=True)), shards)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for tokens, rids, ranks, sizes in _ranked_shards(batches):
            order = np.lexsort((tokens, ranks, rids))
            tokens, rids, sizes = tokens[order], rids[order], sizes[order].astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], rids[1:] != rids[:-1])))
            many = np.diff(np.append(starts, len(rids)))
            n = sizes[starts]
            alone = prefix_size(n) + spare(n, eighths) - many  # tokens of no other record come first
            kept = np.clip(prefix_size(n) - alone, 0, many)
            chosen = np.repeat(starts, kept) + np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
            held.append((tokens[chosen], rids[chosen], sizes[chosen]))
            size += len(chosen)
            if size >= POSTINGS_AT_ONCE:
                yield _posted(held, shards)
                held, size = [], 0
        if size:
            yield _posted(held, shards)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for tokens, rids, sizes in _shards(batches):
            order = np.lexsort((sizes, tokens))
            tokens, rids, sizes = tokens[order], rids[order], sizes[order]
            starts = runs(tokens, sizes)
            least = np.repeat(np.minimum.reduceat(rids, starts), np.diff(np.append(starts, len(rids))))
            edge = least != rids
            a, b = forest(np.concatenate((a, least[edge])), np.concatenate((b, rids[edge])))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(shards // SHARDS, "shard").sortWithinPartitions("shard")

    posted = known.select("rid", "n", "prefix").mapInArrow(lean(post), _POSTED)
    counted = dealt(posted).mapInArrow(lean(count), _RANKED)
    return components(dealt(dealt(counted).mapInArrow(lean(keep), _POSTED)).mapInArrow(lean(stars), "a long, b long"))


_RANKED = "shard int, many int, tokens binary, records binary, numbers binary, ranks binary"


def _with_sizes(tokens: np.ndarray, rids: np.ndarray, ranks: np.ndarray, sizes: np.ndarray, shards: int) -> pa.RecordBatch:
    """Counted postings, packed for the shards of their records."""
    shard = (mix(rids.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((rids, shard))
    found, at = np.unique(shard[order], return_index=True)
    cut = [order[a:b] for a, b in zip(at, np.append(at[1:], len(order)), strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(found.astype(np.int32)),
            pa.array([len(c) for c in cut], pa.int32()),
            pa.array([tokens[c].tobytes() for c in cut], pa.binary()),
            *(pa.array([pack(x[c]) for c in cut], pa.binary()) for x in (rids, sizes.astype(np.int32), np.minimum(ranks, 65535).astype(np.uint16))),
        ],
        names=["shard", "many", "tokens", "records", "numbers", "ranks"],
    )


def _ranked_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    now, parts = None, []
    for batch in batches:
        for shard, many, tokens, rids, sizes, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != now and parts:
                yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                parts = []
            now = shard
            parts.append((np.frombuffer(tokens, np.uint64), unpack(rids, np.int64, many), unpack(ranks, np.uint16, many), unpack(sizes, np.int32, many)))
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def tasks(members: DataFrame) -> DataFrame:
    """``members`` (component, n, key columns) with the ``task`` column: a row for each task
    that has to see the record, and its ``block``. Small components are one task, single records
    none. Pairs of one block are at home in its task 'block.block', those of two in their common one."""
    classed = members.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)) + 1e-9).cast("int"))
    sums = classed.groupBy("component", "size_class").agg(F.sum("n").alias("tokens"), F.count("*").alias("records"))
    whole = sums.groupBy("component").agg(F.sum("records").alias("records"), F.sum("tokens").alias("all_tokens"), F.map_from_entries(F.collect_list(F.struct("size_class", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int")))).alias("salts"))
    joined = classed.join(whole.filter("records > 1").drop("records"), "component")
    # blocks of a class pair up with those of the same and of the two next classes
    salt = "cast(pmod(xxhash64(node, component), salts[size_class]) as int)"
    own = f"""flatten(transform(array(0, 1, 2), d -> transform(sequence(0, coalesce(try_element_at(salts, size_class + d), 0)),
              o -> if(o = coalesce(try_element_at(salts, size_class + d), 0), null,
                   concat_ws('.', size_class, if(d = 0, least(o, s), s), size_class + d, if(d = 0, greatest(o, s), o))))))"""
    other = f"""flatten(transform(array(1, 2), d -> transform(sequence(0, coalesce(try_element_at(salts, size_class - d), 0)),
              o -> if(o = coalesce(try_element_at(salts, size_class - d), 0), null, concat_ws('.', size_class - d, o, size_class, s)))))"""
    places = F.when(F.col("all_tokens") <= BLOCK_TOKENS, F.array(F.lit("all"))).otherwise(F.expr(f"array_distinct(filter(concat({own}, {other}), x -> x is not null))"))
    placed = joined.withColumn("s", F.expr(salt)).withColumn("task", F.explode(places)).withColumn("block", F.concat_ws(".", "size_class", "s"))
    return placed.drop("salts", "s", "all_tokens", "size_class")


def met(assigned: DataFrame, sets: DataFrame, keys: list[str], columns: list[str], verify: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``verify`` applied to the records (``columns``, then the set's bytes) of each task. The
    rows of a task follow one another, so only one task's are held at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, {}, []

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

        for batch in batches:
            for component, task, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (component, task) != now:
                    if len(held) > 1:
                        out += verify(list(held.values()))
                    now, held = (component, task), {}
                held[tuple(row[:-1])] = tuple(row)  # repeated rows are one record
            if len(out) > 50_000:
                yield result()
                out.clear()
        if len(held) > 1:
            out += verify(list(held.values()))
        if out:
            yield result()

    joined = assigned.join(sets, keys).select("component", "task", *columns, "keys")
    return joined.repartition("component", "task").sortWithinPartitions("component", "task").mapInArrow(lean(run), schema)
