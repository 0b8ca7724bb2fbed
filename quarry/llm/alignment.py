"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

Every byte of a text has a label: no token ends here, one of A ends, one of B, or both. A regex
scans the labels for spans up to each "both"; the counts of labels in a span say how many tokens of
A and of B its group has. A token of A and one of B that end together are linked.

Both tokenizers cut a text before a space that follows a character other than white space (checked
when they are loaded, else a text is one word), so a text is aligned word by word, and each distinct
word of a task once. Chunks of documents keep their words as codes into a dictionary of their own;
what is shuffled is a row for each distinct pair of ids of a chunk. The counts of all chunks are
added up, the greatest of each B id found, and sent back to the chunks that hold the pair.

Texts that are null, empty, or that a tokenizer does not give back byte by byte have no tokens:
zeros and the empty string. A very long text is a chunk of its own; ids may be null or repeated
(each row is a document); of the table only the id and the text are read, other columns may have
any names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from quarry.llm.common import lean, pack, slices, spill, table, unpack

FOLDER = "/opt/tokenizers"
NAME_A, NAME_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Words of a chunk, and tokens of the words that a task remembers; both bound its memory.
CHUNK_WORDS, KEPT_TOKENS = 1 << 20, 1 << 22
#: Chunks of a row group: Spark's reader decodes a row group of so few rows at once, and chunks are large.
GROUPED = 4
#: Characters of a text of new words, documents read at once.
RUN, ROWS = 4096, 200
#: A tokenizer's file is sent to every task; vocabularies do not grow with the data.
MOST_FILE = 64 << 20
#: Labels of a byte.
NONE, A_END, B_END, BOTH = 0, 1, 2, 3
_SPAN = re.compile(rb"[^\x03]*\x03")
_INNER_BLANK = re.compile(r"^ |[^\S ] | $|  ")
SPACE = "▁"


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are
    themselves, the others follow one another from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, file_a: bytes, file_b: bytes):
        self.a, self.b = Tokenizer.from_buffer(file_a), sentencepiece.SentencePieceProcessor(model_proto=file_b)
        self.a.encode_special_tokens = True
        char, special = _byte_of_char(), self.a.get_added_tokens_decoder()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = {i: bytes(map(char.__getitem__, t)) for t, i in vocabulary.items() if i not in special}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in y], dtype=np.int64) for y in ([self.bytes_a.get(i, b"") for i in range(max(self.bytes_a) + 1)], self.bytes_b))
        # an id as it is written, before another of its side, at the end of A's, at the end of B's
        self.written = [f"{i}{mark}" for i in range(max(len(self.lengths_a), len(self.lengths_b))) for mark in ",|;"]
        self.blank = self.b.piece_to_id(SPACE)
        # no piece goes on over the start of a word, and white space before a word is all in it
        self.by_words = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) and str(self.a.pre_tokenizer) == 'ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)' and self.a.normalizer is None

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A for space+text and of B for text."""
        both = zip(self.a.encode_batch([f" {t}" for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1), strict=True)
        for text, (a, b) in zip(texts, both, strict=True):
            yield a.ids, b if text else [self.blank]

    def words(self, text: str) -> list[str]:
        """Space+text in words, each without its first space."""
        if not self.by_words:
            return [text]
        parts = text.split(" ")
        if not _INNER_BLANK.search(text):
            return parts
        out, at = [], 0
        while at < len(parts):
            word = parts[at]
            at += 1
            while at < len(parts) and (not word or word[-1].isspace()):
                word = f"{word} {parts[at]}"
                at += 1
            out.append(word)
        return out


@functools.lru_cache(maxsize=1)
def _loaded(file_a: bytes, file_b: bytes) -> Tokenizers:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # in a worker: Spark deals out the cores
    return Tokenizers(file_a, file_b)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(lengths.sum()))


def labels(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> np.ndarray:
    """The label of every byte."""
    out = np.zeros(size, dtype=np.uint8)
    out[ends_a - 1] |= A_END
    out[ends_b - 1] |= B_END
    return out


def groups(labelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The end of each group in bytes, and the numbers of tokens of A and of B up to there."""
    ends = np.cumsum([len(span) for span in _SPAN.findall(labelled.tobytes())], dtype=np.int64)
    return ends, *(np.cumsum((labelled & mark) > 0)[ends - 1] for mark in (A_END, B_END))


class Aligner:
    """Aligned words of a task: what a word has is worked out when it is first met."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.groups: list[str] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # counts and links of words, a part for each call of learn
        self.tokens = 0

    def learn(self, words: list[str]) -> None:
        """New words, side by side in short texts; those that may not stand before a space stand alone."""
        together, alone = [], []
        for word in words:
            (together if word and not word[-1].isspace() and SPACE not in word else alone).append(word)
        runs, run, size = [], [], 0
        for word in together:
            run.append(word)
            size += len(word) + 1
            if size >= RUN:
                runs.append(run)
                run, size = [], 0
        runs += [run] * bool(run) + [[w] for w in alone]
        todo = zip(runs, self.tokenizers.encode([" ".join(r) for r in runs]), strict=True)
        for run, (a, b) in todo:
            if not self._add(run, a, b):
                if len(run) == 1:
                    self.codes[run[0]] = -1  # does not come back byte by byte
                for word in run if len(run) > 1 else []:
                    if not self._add([word], *next(self.tokenizers.encode([word]))):
                        self.codes[word] = -1

    def _add(self, run: list[str], a: list[int], b: list[int]) -> bool:
        t = self.tokenizers
        raw = f" {' '.join(run)}".encode()
        if b"".join(map(t.bytes_a.__getitem__, a)) != raw or b"".join(map(t.bytes_b.__getitem__, b)) != raw:
            return False
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends, to_a, to_b = groups(labels(np.cumsum(t.lengths_a[a]), np.cumsum(t.lengths_b[b]), len(raw)))
        last = np.cumsum([len(w.encode()) + 1 for w in run])
        to_group = np.searchsorted(ends, last) + 1  # groups up to the end of each word
        of_a, of_b = (np.diff(x, prepend=0) for x in (to_a, to_b))
        # a token's text with the mark that follows it; tokens of A stand before those of B in a group
        text = np.empty(len(a) + len(b), dtype=np.int64)
        mark_a, mark_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        mark_a[to_a - 1], mark_b[to_b - 1] = 1, 2
        text[spread(to_a + to_b - of_a - of_b, of_a)] = 3 * a + mark_a
        text[spread(to_a + to_b - of_b, of_b)] = 3 * b + mark_b
        tokens = list(map(t.written.__getitem__, text.tolist()))
        to_token = (to_a + to_b)[to_group - 1].tolist()
        at = 0
        for word, end in zip(run, to_token, strict=True):
            self.codes[word] = len(self.groups)
            self.groups.append("".join(tokens[at:end])[:-1])
            at = end
        counts = np.column_stack([np.diff(x[to_group - 1], prepend=0) for x in (to_a, to_b)] + [np.diff(to_group, prepend=0)])
        self.parts.append((counts, a[to_a - 1] << 32 | b[to_b - 1]))
        self.tokens += len(text)
        return True

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of A and B, groups) of each word, and the links of all words in their order."""
        if len(self.parts) > 1:
            self.parts = [(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))]
        return self.parts[0] if self.parts else (np.empty((0, 3), np.int64), np.empty(0, np.int64))

    def texts(self, batch: list[str]) -> list[list[int]]:
        """The codes of each text's words; none if it has no tokens."""
        words = [self.tokenizers.words(text) if text else [] for text in batch]
        if missing := [w for w in dict.fromkeys(itertools.chain.from_iterable(words)) if w not in self.codes]:
            self.learn(missing)
        out = []
        for text, own in zip(batch, words, strict=True):
            codes = list(map(self.codes.__getitem__, own))
            if -1 in codes:
                if text not in self.codes:
                    self.learn([text])  # as a whole, by the letter of the rule
                codes = [c for c in [self.codes[text]] if c >= 0]
            out.append(codes)
        return out

    def digest(self, codes: list[int]) -> str:
        return hashlib.sha256(";".join(map(self.groups.__getitem__, codes)).encode()).hexdigest() if codes else ""


_CHUNK = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, sizes array<int>, codes binary, held array<int>, link array<int>, a array<int>, b array<int>, n array<long>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of the given sizes."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[ends - sizes]


def _chunk(number: int, aligner: Aligner, rows: list[tuple], codes: list[np.ndarray]) -> pa.RecordBatch:
    """One row: the documents, their words as codes of the chunk, and its distinct pairs of ids."""
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    used, own = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_inverse=True)
    all_counts, all_links = aligner.held()
    counts, starts = all_counts[used], (np.cumsum(all_counts[:, 2]) - all_counts[:, 2])[used]
    times = np.bincount(own, minlength=len(used)).astype(np.int64)
    held = counts[:, 2]
    pairs, link = np.unique(all_links[spread(starts, held)], return_inverse=True)
    n = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(n, link, np.repeat(times, held))
    n_a, n_b, n_groups = (_sums(counts[own, k], sizes) for k in range(3))
    row = (
        number, [r[0] for r in rows], n_a, n_b, n_groups, [r[1] for r in rows], sizes, pack(own.astype(np.uint32)) if len(own) else b"",
        held, link, pairs >> 32, pairs & 0xFFFFFFFF, n,
    )
    types = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in _CHUNK.split(", ")])


def chunks(docs: DataFrame, file_a: bytes, file_b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Aligned documents in chunks of bounded size, each with its distinct pairs and their counts."""
    sent = docs.sparkSession.sparkContext.broadcast((file_a, file_b))  # of bounded size, see files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_loaded(*sent.value))
        number, rows, codes, words = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in slices(batches, ROWS):
            found = aligner.texts([x or "" for x in batch.column(1).to_pylist()])
            for doc_id, own in zip(batch.column(0).to_pylist(), found, strict=True):
                rows.append((doc_id, aligner.digest(own)))
                codes.append(np.array(own, dtype=np.int64))
                words += len(own) + 1  # empty texts fill a chunk too
            if words >= CHUNK_WORDS or aligner.tokens >= KEPT_TOKENS:
                yield _chunk(number, aligner, rows, codes)
                number, rows, codes, words = number + 1, [], [], 0
                if aligner.tokens >= KEPT_TOKENS:
                    aligner.forget()
        if rows:
            yield _chunk(number, aligner, rows, codes)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(run), _CHUNK)


def pair_counts(stored: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold a pair, and whether no other A id has more with its B id."""
    pairs = stored.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return totals.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one chunk, with what all chunks say of its pairs."""
    names = [c.split()[0] for c in _RESULT.split(", ")]
    row = {k: left.column(k).combine_chunks() for k in left.column_names}
    sizes, held, link = (row[k].flatten().to_numpy().astype(np.int64) for k in ("sizes", "held", "link"))
    place, count, best = (right.column(k).to_numpy().astype(np.int64) for k in ("pos", "count", "best"))
    by_pair = np.zeros((2, len(place)), dtype=np.int64)
    by_pair[0, place], by_pair[1, place] = best, count
    words = int(sizes.sum())
    own = unpack(row["codes"][0].as_py(), np.uint32, words) if words else np.empty(0, np.uint32)
    n_best, count_sum = (_sums(_sums(v[link], held)[own], sizes) if words else np.zeros(len(sizes), np.int64) for v in by_pair)
    out = {k: row[k].flatten() for k in names if k in row} | {"n_links": row["n_groups"].flatten(), "n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
    return pa.table([out[k] for k in names], names=names)


def files(folder: str, name_a: str = NAME_A, name_b: str = NAME_B) -> tuple[bytes, bytes]:
    out = []
    for name in (name_a, name_b):
        with open(f"{folder.rstrip('/')}/{name}", "rb") as f:
            out.append(f.read(MOST_FILE + 1))
        if len(out[-1]) > MOST_FILE:
            raise ValueError(f"{name}: a tokenizer's file has {MOST_FILE} bytes at most")
    return out[0], out[1]


def align(docs: DataFrame, folder: str = FOLDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its tokens, groups and links, and how frequent its links are in all documents."""
    stored = spill(chunks(docs, *files(folder), id_col, text_col), "aligned", GROUPED)
    pairs = stored.select("chunk", F.posexplode(F.arrays_zip("a", "b"))).select("chunk", "pos", "col.*")
    answers = pairs.join(pair_counts(stored), ["a", "b"]).select(F.col("chunk").alias("of"), "pos", "count", "best")
    # chunk by chunk: neither side holds the answers or the documents of a partition at once
    return stored.drop("a", "b", "n").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_finish, _RESULT)


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """All whole documents, by the vocabularies in ``FOLDER``."""
    return align(table(spark, sf_dir, "documents"))
