"""Language-model scores from an Elias-Fano n-gram trie that is spread over shards.

Tokens are words (A-Z lower-cased) and one end for each text. The model is a trigram model in
which each order is smoothed towards the one below, as if that had been seen K times more:

    P(w)     = (c(w) + 1) / (N + V + 1)
    P(w|v)   = (c(vw) + K2 P(w)) / (c(v) + K2)
    P(w|uv)  = (c(uvw) + K3 P(w|v)) / (c(uv) + K3)

The start of a text is a context too; its first word has P(w|v). Counts are exact sums over all
training texts, kept as quantised logarithms (steps of 1/4000 of a power of ten); a shard has
no counts of other shards' contexts, so the smoothing is done where the counts meet.

The corpus is tokenised once into chunks, stored with their own small dictionaries. Each
chunk asks every shard for its distinct trigrams, ordered by their last two words (as packed
arrays, with the counts of its training texts). A shard, which owns the pairs of words with
its hashes, adds up what all chunks send, builds its part of the trie (pairs, then the words
before them), searches it for what is asked, and answers every chunk in the order it asked.
So a hot word is spread by its neighbours, each distinct trigram of a chunk travels once, and
no task or driver holds the model. Words and pairs are told apart by 64-bit hashes, the words
before one pair by 40 bits of them.

Null texts are empty: one token, the end. A null id counts as the empty text for the
training split. Without training texts every score is the base score. Repeated rows each
count and are each scored. Very long texts are taken whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, mix, pack, partitions, remainder, small_batches, spill, table, unpack
from quarry.llm.eliasfano import WORD_BITS, Trie, restored
from quarry.llm.tokens import hashed, words

#: What the order below counts for, for pairs and for trigrams.
K2, K3 = 20.0, 2.0
#: Tokens of a chunk, about; texts tokenised at once; shards per shuffle partition, at least;
#: tokens of the corpus for each shard.
CHUNK_TOKENS, TEXTS_AT_ONCE, SHARDS, SHARD_TOKENS = 1_600_000, 500, 2, 2_000_000
# Hashes of the end of a text and of its start (a context only).
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)


def five(words_: np.ndarray) -> np.ndarray:
    """The 5 bytes of each 40-bit word."""
    return np.ascontiguousarray(words_.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0].astype(np.uint64)


# ---- chunks -------------------------------------------------------------------------------

_CHUNK = "chunk long, n_docs int, n_words int, n_tokens int, ids binary, known binary, train binary, ends binary, dictionary binary, tokens binary"


def _chunks(modulus: int, out: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base, number, held, size = (context.partitionId() if context else 0) << 24, 0, [], 0

        def flush() -> pa.RecordBatch:
            hashes, back = np.unique(np.concatenate([h for *_, h in held] + [np.array([END])]), return_inverse=True)
            at, parts = 0, []
            for _, _, _, offsets, index, own in held:
                code = back[at : at + len(own)]
                at += len(own)
                tokens = np.full(len(index) + len(offsets) - 1, back[-1], np.int64)
                tokens[np.arange(len(index)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = code[index]
                parts.append(tokens)
            tokens = np.concatenate(parts)
            order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")  # frequent words get small codes
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ends = np.cumsum(np.concatenate([np.diff(o) + 1 for _, _, _, o, _, _ in held]))
            ids, known, train = (np.concatenate([h[k] for h in held]) for k in range(3))
            row = [base + number, len(ids), len(hashes), len(tokens), pack(ids), pack(known), pack(train), pack(ends), hashes[order].tobytes(), pack(rank[tokens].astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array([x]) if isinstance(x, bytes) else pa.array([x], pa.int64() if k == 0 else pa.int32()) for k, x in enumerate(row)], names=[c.split()[0] for c in _CHUNK.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                offsets, index, dictionary = words(part.column(1))
                ids = part.column(0)
                held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), remainder(ids, modulus) != out, offsets, index, hashed(dictionary)))
                size += len(index)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return run


class Chunk:
    """A stored chunk, unpacked, with its distinct pairs and trigrams in a fixed order."""

    def __init__(self, row: dict):
        docs, n, tokens = row["n_docs"], row["n_words"], row["n_tokens"]
        self.id = row["chunk"]
        self.ids, self.known, self.train = unpack(row["ids"], np.int64, docs), unpack(row["known"], np.bool_, docs), unpack(row["train"], np.bool_, docs)
        self.ends = unpack(row["ends"], np.int64, docs)
        self.hashes = np.append(np.frombuffer(row["dictionary"], np.uint64), START)
        self.tokens = unpack(row["tokens"], np.uint32, tokens).astype(np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1]))
        self.trained = np.repeat(self.train, np.diff(np.append(self.starts, tokens)))
        self.before = np.concatenate(([n], self.tokens[:-1]))
        self.before[self.starts] = n

    def word_counts(self) -> np.ndarray:
        """Training count of each word of the dictionary, of the start the training texts."""
        counts = np.bincount(self.tokens[self.trained], minlength=len(self.hashes))
        counts[-1] = np.count_nonzero(self.train)
        return counts

    def grams(self) -> None:
        """``pair`` of each token, and of each pair its hash, by which they are numbered, and the code
        of its word and context; ``gram`` of each token, and of each trigram its pair and first word."""
        many = len(self.hashes)
        codes, place = np.unique(self.before * many + self.tokens, return_inverse=True)
        context, word = codes // many, codes % many
        with np.errstate(over="ignore"):
            keys = mix(self.hashes[context] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[word])
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys, self.context, self.word, self.pair = keys[order], context[order], word[order], rank[place]
        first = np.concatenate(([many - 1], self.before[:-1]))
        first[self.starts] = many - 1
        codes, self.gram = np.unique(self.pair * many + first, return_inverse=True)
        self.gram_pair, self.gram_first = codes // many, codes % many
        self.gram_counts = np.bincount(self.gram[self.trained], minlength=len(codes))


def _dealt(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in their order) of each shard that occurs."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    found, at = np.unique(shard[order], return_index=True)
    for s, a, b in zip(found.tolist(), at, np.append(at[1:], len(order)), strict=True):
        yield s, order[a:b]


_ASK = "shard int, chunk long, n int, grams int, pairs binary, lengths binary, words binary, counts binary"
_ANSWER = "kind string, shard int, chunk long, n int, first binary, second binary"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _cuts(keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of the shards of ascending 64-bit keys."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    found, at = np.unique(shard, return_index=True)
    yield from zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(keys)], strict=True)


def _ask_grams(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            chunk.grams()
            bounds = np.searchsorted(chunk.gram_pair, np.arange(len(chunk.keys) + 1))
            words_, out = chunk.hashes >> np.uint64(64 - WORD_BITS), []
            for shard, a, b in _cuts(chunk.keys, shards):
                c, d = bounds[a], bounds[b]
                steps = np.diff(chunk.keys[a:b], prepend=np.uint64(0))
                out.append((shard, chunk.id, b - a, int(d - c), pack(steps), pack(np.diff(bounds[a : b + 1]).astype(np.uint32)), five(words_[chunk.gram_first[c:d]]).tobytes(), pack(chunk.gram_counts[c:d].astype(np.uint32))))
            if out:
                yield _batch(_ASK, out)

    return run


def _each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    now, held = None, []
    for row in _rows(batches):
        if row["shard"] != now and held:
            yield now, held
            held = []
        now = row["shard"]
        held.append(row)
    if held:
        yield now, held


def _answer_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, asked in _each_shard(batches):
        pair = np.concatenate([np.cumsum(unpack(r["pairs"], np.uint64, r["n"])) for r in asked])
        owner = np.repeat(np.arange(len(pair)), np.concatenate([unpack(r["lengths"], np.uint32, r["n"]) for r in asked]))
        word = np.concatenate([from_five(r["words"]) for r in asked])
        counts = np.concatenate([unpack(r["counts"], np.uint32, r["grams"]) for r in asked])
        pairs, pair_at = np.unique(pair, return_inverse=True)
        grams, gram_at = np.unique(pair_at[owner].astype(np.uint64) << np.uint64(WORD_BITS) | word, return_inverse=True)
        total = np.bincount(gram_at, weights=counts, minlength=len(grams)).astype(np.int64)
        own, last = (grams >> np.uint64(WORD_BITS)).astype(np.int64), grams & np.uint64((1 << WORD_BITS) - 1)
        pair_total = np.bincount(own, weights=total, minlength=len(pairs)).astype(np.int64)
        seen, taught = np.flatnonzero(pair_total), total > 0
        number = np.cumsum(pair_total > 0) - 1
        trie = Trie(pairs[seen], pair_total[seen], number[own[taught]], last[taught], total[taught])
        place, pair_codes = trie.find(pairs)
        gram_codes = trie.lookup(place[own], last)
        a = b = 0
        for r in asked:
            n, m = r["n"], r["grams"]
            yield _batch(_ANSWER, [("grams", shard, r["chunk"], n, pack(pair_codes[pair_at[a : a + n]]), pack(gram_codes[gram_at[b : b + m]]))])
            a, b = a + n, b + m


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            counts = chunk.word_counts().astype(np.uint32)
            places = _dealt((chunk.hashes % np.uint64(shards)).astype(np.int64))
            yield _batch(_ANSWER, [("words", s, chunk.id, len(at), chunk.hashes[at].tobytes(), pack(counts[at])) for s, at in places])

    return run


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, asked in _each_shard(batches):
        every, place = np.unique(np.concatenate([np.frombuffer(r["first"], np.uint64) for r in asked]), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([unpack(r["second"], np.uint32, r["n"]) for r in asked]), minlength=len(every)).astype(np.int64)
        tokens = np.where(every == START, 0, count)
        out, at = [("totals", shard, int(tokens.sum()), int(np.count_nonzero(tokens)), None, None)], 0
        for r in asked:
            out.append(("words", shard, r["chunk"], r["n"], pack(count[place[at : at + r["n"]]]), None))
            at += r["n"]
        yield _batch(_ANSWER, out)


_SCORE = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(tokens: int, types: int, shards: int, k2: float, k3: float):
    def run(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(chunks):
            return pd.DataFrame({c.split()[0]: [] for c in _SCORE.split(", ")})
        chunk = Chunk(chunks.iloc[0].to_dict())
        chunk.grams()
        told = {(r.kind, r.shard): r for r in answers.itertuples()}
        count = np.zeros(len(chunk.hashes), np.int64)
        for shard, at in _dealt((chunk.hashes % np.uint64(shards)).astype(np.int64)):
            r = told["words", shard]
            count[at] = unpack(r.first, np.int64, r.n)
        bounds = np.searchsorted(chunk.gram_pair, np.arange(len(chunk.keys) + 1))
        pair_codes, gram_codes = np.zeros(len(chunk.keys), np.uint16), np.zeros(len(chunk.gram_pair), np.uint16)
        for shard, a, b in _cuts(chunk.keys, shards):
            r = told["grams", shard]
            pair_codes[a:b] = unpack(r.first, np.uint16, r.n)
            gram_codes[bounds[a] : bounds[b]] = unpack(r.second, np.uint16, int(bounds[b] - bounds[a]))
        one = (count + 1.0) / (tokens + types + 1.0)
        pair_counts = restored(pair_codes)
        two = (pair_counts + k2 * one[chunk.word]) / (count[chunk.context] + k2)
        above = np.concatenate(([0.0], pair_counts[chunk.pair[:-1]]))  # of the pair that comes before
        three = (restored(gram_codes)[chunk.gram] + k3 * two[chunk.pair]) / (above + k3)
        three[chunk.starts] = two[chunk.pair[chunk.starts]]
        sums = lambda x: np.add.reduceat(x, chunk.starts)
        return pd.DataFrame(
            {
                "doc_id": pd.arrays.IntegerArray(chunk.ids.copy(), ~chunk.known),
                "train": chunk.train,
                "n_tokens": np.diff(np.append(chunk.starts, len(chunk.tokens))),
                "n_known": sums((count[chunk.tokens] > 0).astype(np.int64)),
                "base_score": sums(np.log10(one)[chunk.tokens]),
                "score": sums(np.log10(three)),
            }
        )

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, out: int = 2, k2: float = K2, k3: float = K3) -> DataFrame:
    """Scores of all texts by the model of those whose crc32(id as text) mod ``modulus`` is
    not ``out``; ``train`` says which those are."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = spill(rows.mapInArrow(lean(_chunks(modulus, out)), _CHUNK), "chunks")
    size = int(chunks.agg(F.sum(F.col("n_tokens").cast("long"))).first()[0] or 0)
    shards = max(SHARDS * partitions(spark), -(-size // SHARD_TOKENS))
    parts = shards // SHARDS
    asked = chunks.mapInArrow(lean(_ask_grams(shards)), _ASK).repartition(parts, "shard").sortWithinPartitions("shard", "chunk")
    grams = spill(asked.mapInArrow(lean(_answer_grams), _ANSWER), "grams")
    asked = chunks.mapInArrow(lean(_ask_words(shards)), _ANSWER)
    answered = spill(asked.repartition(parts, "shard").sortWithinPartitions("shard", "chunk").mapInArrow(lean(_answer_words), _ANSWER), "words")
    totals = answered.filter("kind = 'totals'").agg(F.sum("chunk"), F.sum("n")).collect()[0]
    tokens, types = int(totals[0] or 0), int(totals[1] or 0)
    answers = grams.unionByName(answered.filter("kind = 'words'"))
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_scorer(tokens, types, shards, k2, k3), _SCORE)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op4_lm_scores(spark, sf_dir: str) -> DataFrame:
    out = scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
