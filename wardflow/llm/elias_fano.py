"""Elias-Fano sequences: rising integers in few bits each, searched in place.

Every number is cut into low bits, stored side by side, and high bits, stored as
a bit vector with a one per number and a zero per high value. A directory counts
the ones before each 64-bit word of it.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def encode(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
    """Arrays of a rising sequence of numbers below ``universe``."""
    n = len(values)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    low = min(low, 57)  # so that a number's low bits lie in two bytes-aligned words
    values = values.astype(np.uint64)
    high = (values >> np.uint64(low)).astype(np.int64)
    bits = n + (int(high[-1]) if n else 0) + 1
    words = np.zeros(bits // 64 + 1, np.uint64)
    at = high + np.arange(n)
    np.bitwise_or.at(words, at >> 6, _ONE << (at & 63).astype(np.uint64))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    if n < 1 << 31:
        ones = ones.astype(np.int32)
    packed = np.zeros(n * low // 64 + 2, np.uint64)
    if low:
        rest = values & np.uint64((1 << low) - 1)
        start = np.arange(n, dtype=np.int64) * low
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        np.bitwise_or.at(packed, word, rest << shift)
        over = shift > np.uint64(64 - low)
        np.bitwise_or.at(packed, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
    return {f"{name}.low": packed, f"{name}.high": words, f"{name}.ones": ones,
            f"{name}.size": np.array([n, low], np.int64)}


def _select_table() -> np.ndarray:
    """Place of the k-th one (from 0) of each byte; 8 if there is none."""
    table = np.full((256, 8), 8, np.uint8)
    for byte in range(256):
        places = [i for i in range(8) if byte >> i & 1]
        table[byte, :len(places)] = places
    return table


_SELECT = _select_table()


_BYTES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each word, which has more ones than k."""
    parts = np.ascontiguousarray(word).astype("<u8", copy=False).view(np.uint8)
    # In byte i the ones of bytes 0 to i: 64 at most, so no byte runs over.
    upto = np.bitwise_count(parts).view("<u8") * _BYTES
    k = k.astype(np.uint64)
    # The top bit stays in the bytes that reach beyond the k-th one.
    beyond = ((upto | _TOPS) - (k + _ONE) * _BYTES) & _TOPS
    byte = 8 - np.bitwise_count(beyond).astype(np.int64)
    before = (upto << np.uint64(8)) >> (byte * 8).astype(np.uint64) & np.uint64(0xFF)
    row = np.arange(0, len(parts), 8)
    return byte * 8 + _SELECT[parts[row + byte], (k - before).astype(np.int64)]


class EliasFano:
    """A sequence in arrays made by ``encode``."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self._low, self._high = arrays[f"{name}.low"], arrays[f"{name}.high"]
        self._ones = arrays[f"{name}.ones"]
        self.n, self._bits = (int(x) for x in arrays[f"{name}.size"])
        self._zeros = None

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self._bits:
            return np.zeros(len(i), np.uint64)
        start = i * self._bits
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        left = self._low[word] >> shift
        # A shift by 64 is not defined: split it.
        right = self._low[word + 1] << (np.uint64(63) - shift) << _ONE
        return (left | right) & np.uint64((1 << self._bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        # Of the directory's type, which else would be copied to be searched.
        word = np.searchsorted(self._ones, i.astype(self._ones.dtype), "right") - 1
        at = word * 64 + _select_in_word(self._high[word], i - self._ones[word])
        return ((at - i).astype(np.uint64) << np.uint64(self._bits)) | self._lows(i)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, the last excluded, of the numbers with these high bits."""
        if self._zeros is None:
            self._zeros = np.arange(len(self._ones), dtype=np.int64) * 64 - self._ones
        # The bucket's ones lie behind the zero that ends the bucket before.
        start, stop = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        at = self._zero(high - 1) + 1
        np.subtract(at, high, out=start)
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        inside = word < len(self._high)
        ones = np.full(len(high), 64, np.int64)
        rest = ~(self._high[word[inside]] >> shift[inside])
        # The lowest bit of the rest marks the end of the run.
        ones[inside] = np.bitwise_count((rest & (~rest + _ONE)) - _ONE)
        stop[:] = start + ones
        long = (at & 63) + ones >= 64
        stop[long] = self._zero(high[long]) - high[long]
        return np.minimum(start, self.n), np.minimum(stop, self.n)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the bit vector; before the first, -1."""
        total = int(self._zeros[-1])
        inside = np.clip(k, 0, total - 1)
        word = np.searchsorted(self._zeros, inside, "right") - 1
        at = word * 64 + _select_in_word(~self._high[word], inside - self._zeros[word])
        return np.where(k < 0, -1, np.where(k >= total, self.n + k, at))

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number not below each ``x``, and whether it equals it."""
        x = x.astype(np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        low, stop = self._bucket((x >> np.uint64(self._bits)).astype(np.int64))
        target = x & np.uint64((1 << self._bits) - 1)
        equal = np.zeros(len(x), bool)
        todo = np.flatnonzero(low < stop)
        # Those not yet found, side by side.
        start, end, wanted = low[todo], stop[todo], target[todo]
        while len(todo):
            middle = (start + end) >> 1
            there = self._lows(middle)
            below = there < wanted
            # The last number that was not below is the one that is found.
            equal[todo] = np.where(below, equal[todo], there == wanted)
            start, end = np.where(below, middle + 1, start), np.where(below, end, middle)
            low[todo] = start
            left = np.flatnonzero(start < end)
            todo, start, end, wanted = todo[left], start[left], end[left], wanted[left]
        return low, equal
