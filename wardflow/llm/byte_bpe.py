"""Byte-level BPE by padded matrices: encoding to ids, decoding to bytes.

Each text is cut by the pattern. Distinct pieces are sorted into matrices by
length, a row of byte ids each, padded to the matrix's width. In a round every
row merges its leftmost pair of least rank, found in a hash table of pairs; the
ids behind it move up, and finished rows leave the matrix. A piece of more than
``LONG`` bytes would make its matrix too wide and takes the same merges from a
heap instead.

Defined results: a null or empty text has no ids. Ids that are not in the
vocabulary are refused on decoding. Other columns pass unchanged, whatever their
names. Repeated rows are coded each; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from wardflow.llm import words as W
from wardflow.llm.pieces import PieceTable, ranges

LONG = 4096
# Texts are taken in groups of about this many characters.
GROUP_CHARS = 1 << 18
# Byte ids that a matrix holds at most.
CELLS = 1 << 17
# Pieces taken at a time from a text longer than a group.
_STRETCH = 200_000
_NONE = np.int32(2 ** 31 - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id they merge into."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self._bits = max(4, int(2 * len(left)).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._ids = np.full(1 << self._bits, _NONE, np.int32)
        keys = self._key(left, right)
        slot, left_over = self._slot(keys), np.arange(len(keys))
        while len(left_over):
            free = left_over[self._keys[slot[left_over]] < 0]
            # Of several keys for one free slot, one gets it.
            _, first = np.unique(slot[free], return_index=True)
            self._keys[slot[free[first]]] = keys[free[first]]
            self._ids[slot[free[first]]] = merged[free[first]]
            left_over = left_over[self._keys[slot[left_over]] != keys[left_over]]
            slot[left_over] = (slot[left_over] + 1) & (len(self._keys) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _FACTOR >> np.uint64(64 - self._bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids; ``_NONE`` for pairs that do not merge or hold padding."""
        shape = left.shape
        keys = np.where((left < 0) | (right < 0), -2, self._key(left, right)).ravel()
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.flatnonzero(keys >= 0)
        slot = self._slot(keys[todo])
        while len(todo):
            found = self._keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self._ids[slot[hit]]
            on = ~hit & (found >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self._keys) - 1)
        return out.reshape(shape)


class Vocabulary:
    """Ranks of a rank file, as hash table of pairs and as bytes by id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pairs = [(ranks[token[:i]], ranks[token[i:]], rank)
                 for token, rank in ranks.items() for i in range(1, len(token))
                 if token[:i] in ranks and token[i:] in ranks]
        left, right, merged = np.array(pairs, np.int32).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged)
        self._pair = None
        self._all = (left, right, merged)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = ranks
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.zeros(int(self.starts[-1]), np.uint8)
        for token, rank in ranks.items():
            self.bytes[self.starts[rank]:self.starts[rank + 1]] = np.frombuffer(token, np.uint8)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces after each other, and how many each has."""
        raw = [p.encode("utf-8") for p in pieces]
        known = [self.whole.get(r) for r in raw]
        out: list[np.ndarray | None] = [None if k is None else np.array([k], np.int32)
                                        for k in known]
        rest = np.array([i for i, k in enumerate(known) if k is None], np.int64)
        size = np.array([len(raw[i]) for i in rest], np.int64)
        for i in rest[size > LONG]:
            out[i] = self._merge_long(raw[i])
        width = 2
        while width <= LONG:
            own = rest[(size > width // 2) & (size <= width)] if width > 2 else rest[size <= 2]
            for k in range(0, len(own), CELLS // width):
                self._merge_matrix(raw, own[k:k + CELLS // width], width, out)
            width *= 2
        counts = np.array([len(x) for x in out], np.int64)
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def _merge_matrix(self, raw: list[bytes], rows: np.ndarray, width: int, out: list) -> None:
        if not len(rows):
            return
        size = np.array([len(raw[i]) for i in rows])
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.of_byte[
            np.frombuffer(b"".join(raw[i] for i in rows), np.uint8)]
        rank = self.pairs.merged(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = rank.argmin(axis=1)  # the leftmost of equal ranks
            best = rank[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                for row, line in zip(rows[done], ids[done], strict=True):
                    out[row] = line[line >= 0]
                go = ~done
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            ids[each, at] = best
            behind = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[:, :-1][behind] = ids[:, 1:][behind]
            ids[:, -1] = -1
            behind = np.arange(rank.shape[1] - 1) > at[:, None]
            rank[:, :-1][behind] = rank[:, 1:][behind]
            rank[:, -1] = _NONE
            longest = max(int((ids >= 0).sum(axis=1).max()), 2)
            if longest < ids.shape[1]:
                ids = np.ascontiguousarray(ids[:, :longest])
                rank = np.ascontiguousarray(rank[:, :longest - 1])
            # Only the pairs on both sides of the merged one are new.
            here = at < rank.shape[1]
            rank[each[here], at[here]] = self.pairs.merged(ids[each[here], at[here]],
                                                           ids[each[here], at[here] + 1])
            left = at > 0
            rank[each[left], at[left] - 1] = self.pairs.merged(ids[each[left], at[left] - 1],
                                                               ids[each[left], at[left]])

    def _merge_long(self, raw: bytes) -> np.ndarray:
        if self._pair is None:
            left, right, merged = (x.tolist() for x in self._all)
            self._pair = dict(zip(zip(left, right, strict=True), merged, strict=True))
        ids = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        heap = [(self._pair[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False))
                if p in self._pair]
        heapq.heapify(heap)
        while heap:
            rank, i, (a, b) = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                pair = (rank, ids[after[i]])
                if pair in self._pair:
                    heapq.heappush(heap, (self._pair[pair], i, pair))
            if before[i] >= 0:
                pair = (ids[before[i]], rank)
                if pair in self._pair:
                    heapq.heappush(heap, (self._pair[pair], before[i], pair))
        return np.array([x for x in ids if x >= 0], np.int32)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _groups(column: pa.Array):
    """Texts in order, in groups of about ``GROUP_CHARS``."""
    group, chars = [], 0
    for text in column:
        text = text.as_py() or ""
        group.append(text)
        chars += len(text)
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def _encode_group(texts: list[str], pattern, table: PieceTable) -> tuple[np.ndarray, list[int]]:
    if len(texts) == 1 and len(texts[0]) > GROUP_CHARS:
        found = (m.group() for m in pattern.finditer(texts[0]))
        parts = []
        while stretch := list(islice(found, _STRETCH)):
            parts.append(table.ids(stretch)[0])
        ids = np.concatenate(parts)
        return ids, [len(ids)]
    pieces, counts = [], []
    for text in texts:
        own = pattern.findall(text)
        pieces += own
        counts.append(len(own))
    ids, sizes = table.ids(pieces)
    total = np.concatenate([[0], np.cumsum(sizes)])
    return ids, np.diff(total[np.concatenate([[0], np.cumsum(counts)])]).tolist()


@lru_cache(maxsize=2)
def _pieces(ranks: str) -> PieceTable:
    """Pieces known to this worker, kept for its next tasks."""
    return PieceTable(_vocabulary(ranks).encode)


def _encoded(column: pa.Array, ranks: str, cut) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Ids of the texts of a column, group by group, and each text's number of them."""
    for group in _groups(column):
        yield _encode_group(group, cut, _pieces(ranks))


def _lists(ids: list[np.ndarray], sizes: list[int]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(
        np.concatenate([np.zeros(0, np.int32), *ids])))


def _decoded(ids: np.ndarray, sizes: list[int], ranks: str) -> list[bytes]:
    """The bytes of runs of ids after each other."""
    vocabulary = _vocabulary(ranks)
    ids = ids.astype(np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.starts) - 1):
        raise ValueError("an id is not in the vocabulary")
    starts = vocabulary.starts[ids]
    counts = vocabulary.starts[ids + 1] - starts
    data = vocabulary.bytes[ranges(starts, counts)].tobytes()
    at = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text",
           name: str = "tokens") -> DataFrame:
    """``docs`` with a struct ``tokens.ids``: the ids of the whole text.

    ``ranks``: a rank file that every executor has at that path.
    """
    def compute(column: pa.Array) -> list:
        ids, sizes = [], []
        for own, counts in _encoded(column, ranks, regex.compile(pattern)):
            ids.append(own)
            sizes += counts
        return [_lists(ids, sizes)]

    return W.add_struct(docs, text, name, StructType().add("ids", ArrayType(IntegerType())),
                        compute)


def decode(docs: DataFrame, ranks: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with a struct ``decoded.bytes``: the bytes of the ids; null for null ids."""
    def compute(column: pa.Array) -> list:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        sizes = column.value_lengths().fill_null(0).to_pylist()
        null = column.is_null().to_pylist() if column.null_count else [False] * len(column)
        return [pa.array([None if gone else x for x, gone in
                          zip(_decoded(flat, sizes, ranks), null, strict=True)], pa.binary())]

    return W.add_struct(docs, ids, name, StructType().add("bytes", BinaryType()), compute)


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, text: str = "text",
                      name: str = "tokens") -> DataFrame:
    """``docs`` with a struct of the text's ``ids`` and the ``bytes`` they decode to.

    Both ways in one pass, group by group.
    """
    fields = StructType().add("ids", ArrayType(IntegerType())).add("bytes", BinaryType())

    def compute(column: pa.Array) -> list:
        ids, sizes, data = [], [], []
        for own, counts in _encoded(column, ranks, regex.compile(pattern)):
            ids.append(own)
            sizes += counts
            data += _decoded(own, counts, ranks)
        return [_lists(ids, sizes), pa.array(data, pa.binary())]

    return W.add_struct(docs, text, name, fields, compute)
