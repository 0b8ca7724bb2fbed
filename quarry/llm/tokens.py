"""Words and word shingles of whole Arrow batches, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.common import mix

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


#: Lower-cases A-Z.
_LOWER = bytes(range(256)).lower()
#: Lower-cases A-Z and makes every other ASCII character but letters and digits a blank.
_PLAIN = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def compact(texts: pa.Array, table: bytes | None = None) -> pa.Array:
    """The texts in buffers of their own that start at 0, null as empty, with each byte
    replaced by ``table``. (Arrow's own kernels misread the buffers of some slices.)"""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts) or texts.buffers()[2] is None:
        return pa.array([""] * len(texts), pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = bytes(memoryview(texts.buffers()[2])[int(offsets[0]) : int(offsets[-1])])
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data.translate(table)))


def plain(texts: pa.Array) -> pa.Array:
    """Lower-cased texts with blanks for ASCII punctuation, of the same lengths."""
    return compact(texts, _PLAIN)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets of each text's words, index of each word in the dictionary, dictionary).

    A-Z are lower-cased and words are runs without the six ASCII blanks; null is empty."""
    split = pc.ascii_split_whitespace(compact(texts, _LOWER))
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    coded = pc.dictionary_encode(flat.filter(full))
    return kept[offsets], coded.indices.to_numpy().astype(np.int64), coded.dictionary


def hashed(dictionary: pa.Array) -> np.ndarray:
    """64-bit hashes of the words: their bytes are taken eight at a time and mixed in."""
    if not len(dictionary):
        return np.zeros(0, np.uint64)
    words_ = compact(dictionary)
    offsets = np.frombuffer(words_.buffers()[1], dtype=np.int64)[: len(words_) + 1]
    raw = (words_.buffers()[2].to_pybytes() if words_.buffers()[2] else b"") + bytes(8)
    eights = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
    left = np.diff(offsets)
    out = mix(left.astype(np.uint64) + _FACTOR)
    at, todo = offsets[:-1].copy(), np.flatnonzero(left > 0)
    while len(todo):
        lane = eights[at[todo]]
        short = np.flatnonzero(left[todo] < 8)
        lane[short] &= (np.uint64(1) << (left[todo[short]].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        with np.errstate(over="ignore"):
            out[todo] = mix(out[todo] * _FACTOR + lane)
        at[todo] += 8
        left[todo] -= 8
        todo = todo[left[todo] > 0]
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hash of each word)."""
    offsets, index, dictionary = words(texts)
    return offsets, hashed(dictionary)[index] if len(index) else np.zeros(0, np.uint64)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (len - n + 1 of them)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _FACTOR + hashes[k : k + count]
    return mix(out)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: n words each, or the whole shorter
    sequence as one, or none at all."""
    offsets, hashes = word_hashes(texts)
    all_grams, out = grams(hashes, n), []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            sorted_grams = np.sort(all_grams[a : b - n + 1])
            keep = np.ones(len(sorted_grams), bool)
            np.not_equal(sorted_grams[1:], sorted_grams[:-1], out=keep[1:])
            out.append(sorted_grams[keep])
        else:
            out.append(grams(hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out
