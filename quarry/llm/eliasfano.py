"""Elias-Fano sequences and a two-level n-gram trie built of them, in memory-mapped levels
that are searched as they are: no level is decoded."""

from __future__ import annotations

import tempfile

import numpy as np

#: Bits of a word within a context, and steps of a quantised logarithm.
WORD_BITS = 40
SCALE, SHIFT = 4000, 4001
#: 64-bit words of a block of the directory, and queries answered at once.
BLOCK, AT_ONCE = 8, 1 << 18
_ONE = np.uint64(1)


class Levels:
    """Arrays written one after another to an unlinked file and mapped back."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()  # noqa: SIM115  lives as long as the maps

    def put(self, array: np.ndarray) -> np.ndarray:
        if not array.size:
            return array
        self.file.seek(0, 2)
        at = -(-self.file.tell() // 8) * 8
        self.file.seek(at)
        self.file.write(np.ascontiguousarray(array).tobytes())
        self.file.flush()
        return np.memmap(self.file, dtype=array.dtype, mode="r", offset=at, shape=array.shape)


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the one with ``rank`` ones before it in each word."""
    place = np.zeros(len(words), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(words & ((_ONE << np.uint64(step)) - _ONE)).astype(np.int64)
        on = rank >= below
        rank = rank - below * on
        words = np.where(on, words >> np.uint64(step), words)
        place += step * on
    return place


class EliasFano:
    """A sequence of ascending uint64 values.

    The low bits of each value lie in arrays of their own. The high bits are a bit vector: for
    each high part a one for every value that has it, then a zero. A directory counts the ones
    before each block of the vector; all else is found by counting bits."""

    def __init__(self, values: np.ndarray, levels: Levels):
        self.n = n = len(values)
        if not n:
            return
        self.low_bits = low = min(48, max(0, (int(values[-1]) // n).bit_length() - 1))
        high = (values >> np.uint64(low)).astype(np.int64)
        self.buckets = int(high[-1]) + 1
        bits = np.zeros(-(-(self.buckets + n) // (64 * BLOCK)) * 64 * BLOCK, np.uint8)
        bits[high + np.arange(n)] = 1
        upper = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(upper).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        self.upper = levels.put(upper)
        self.ones = levels.put(np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.uint32))
        self.low32 = levels.put((values & np.uint64((1 << min(low, 32)) - 1)).astype(np.uint32))
        self.low16 = levels.put((values >> np.uint64(32) & np.uint64((1 << (low - 32)) - 1)).astype(np.uint16)) if low > 32 else None

    def low(self, at: np.ndarray) -> np.ndarray:
        out = self.low32[at].astype(np.uint64)
        return out if self.low16 is None else out | self.low16[at].astype(np.uint64) << np.uint64(32)

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """The place in the bit vector of the one (or zero) with ``rank`` such before it."""
        before = self.ones.astype(np.int64)
        if not ones:
            before = np.arange(len(before)) * 64 * BLOCK - before
        block = np.searchsorted(before, rank, "right") - 1
        rank, word = rank - before[block], block * BLOCK
        own = self.upper[word] if ones else ~self.upper[word]
        for _ in range(BLOCK - 1):
            many = np.bitwise_count(own).astype(np.int64)
            on = rank >= many
            if not on.any():
                break
            rank, word = rank - many * on, word + on
            own = self.upper[word] if ones else ~self.upper[word]
        return word * 64 + _in_word(own, rank)

    def access(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(at, True) - at).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self.low(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 for none: its high part gives a range, searched by low parts."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high = values >> np.uint64(self.low_bits)
        known = np.flatnonzero(high < np.uint64(self.buckets))
        high, low = high[known].astype(np.int64), values[known] & np.uint64((1 << self.low_bits) - 1)
        end = self._select(high, False) - high
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)
        at = _least(start, end, lambda at, rows: self.low(at) < low[rows])
        hit = np.flatnonzero(at < end)
        hit = hit[self.low(at[hit]) == low[hit]]
        out[known[hit]] = at[hit]
        return out


def _least(start: np.ndarray, end: np.ndarray, less) -> np.ndarray:
    """The first place of each range [start, end) that is not ``less``, by halving; else its end."""
    start, end = start.copy(), end.copy()
    open_ = np.flatnonzero(start < end)
    while len(open_):
        middle = (start[open_] + end[open_]) // 2
        low = less(middle, open_)
        start[open_] = np.where(low, middle + 1, start[open_])
        end[open_] = np.where(low, end[open_], middle)
        open_ = open_[start[open_] < end[open_]]
    return start


def quantised(value: np.ndarray) -> np.ndarray:
    """Codes from 1 for log10 of numbers from 1 on; 0 is for none."""
    return (np.rint(np.log10(np.maximum(value, 1)) * SCALE) + SHIFT).clip(1, 65535).astype(np.uint16) * (value > 0)


def restored(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(np.float64) - SHIFT) / SCALE), 0.0)


class Trie:
    """Contexts (64-bit) with their words (``WORD_BITS``-bit), both with quantised values.

    The first level holds the contexts and monotone pointers to where their words start; the
    second the words, ascending over all contexts since each context adds one block of the
    level's universe. A word is searched among those of its context."""

    def __init__(self, context: np.ndarray, context_value: np.ndarray, owner: np.ndarray, word: np.ndarray, value: np.ndarray):
        """Contexts ascend; ``owner`` is the number of each word's context; (owner, word) ascend."""
        self.levels = Levels()
        self.contexts = EliasFano(context, self.levels)
        self.context_values = self.levels.put(quantised(context_value))
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(context))))).astype(np.uint64)
        self.pointers = EliasFano(ends, self.levels)
        self.words = EliasFano(owner.astype(np.uint64) << np.uint64(WORD_BITS) | word, self.levels)
        self.values = self.levels.put(quantised(value))

    def find(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, code) of each context, -1 and 0 for none."""
        places = [self.contexts.find(context[k : k + AT_ONCE]) for k in range(0, len(context), AT_ONCE)]
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        codes = np.zeros(len(place), np.uint16)
        hit = np.flatnonzero(place >= 0)
        codes[hit] = self.context_values[place[hit]]
        return place, codes

    def lookup(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each word after the context with number ``place``, 0 for none."""
        out = np.zeros(len(place), np.uint16)
        for k in range(0, len(place), AT_ONCE):
            known = np.flatnonzero(place[k : k + AT_ONCE] >= 0) + k
            if not len(known) or not self.words.n:
                continue
            own = place[known]
            start, end = (self.pointers.access(own + x).astype(np.int64) for x in (0, 1))
            wanted = own.astype(np.uint64) << np.uint64(WORD_BITS) | word[known]
            at = _least(start, end, lambda at, rows, wanted=wanted: self.words.access(at) < wanted[rows])
            hit = np.flatnonzero(at < end)
            hit = hit[self.words.access(at[hit]) == wanted[hit]]
            out[known[hit]] = self.values[at[hit]]
        return out
