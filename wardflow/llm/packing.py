"""Packing of token sequences into windows by non-negative least squares.

Every text is cut into full windows and a rest. The rests' lengths are counted,
rounded up to bins. All combinations of up to ``DEPTH`` bins that fill a window
are enumerated, and repeat counts that come closest to the histogram are solved
by non-negative least squares and rounded down. What is left is packed greedily:
the longest rest opens a window, and the longest that still fit fill it, as
often as the counts allow. The plan holds lengths and repeat counts only, so its
size depends on the window and not on the number of texts. Rests take their
places in it by their number among those of equal length.

Parts of words of a block of texts are told apart by 64-bit hashes, and each is
encoded once.

Defined results: a null or empty text is the end id alone. Repeated rows, and rows
without an id, are packed each. No tokens are dropped; a sequence holds at most
``window`` of them. Other columns, whatever their names, are not read. An empty table
gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from wardflow.llm import words as W
from wardflow.llm.pieces import PieceTable, ranges
from wardflow.llm.places import Counter, placed
from wardflow.session import settle

WINDOW = 4096
END = 2
DEPTH = 3
BINS = 128
# Parts of words that a worker remembers before it begins anew.
KNOWN = 200_000


# -- tokens -------------------------------------------------------------------

@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    # Tasks are the threads here; the library's own cost more than they save.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their names in a text are ordinary text
    return found


# Words that are encoded as one line: a call has a cost of its own.
_LINE = 256


def _encode(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    # This vocabulary never joins across white space, so a word's ids do not depend
    # on its neighbours; an id belongs to the word in which its characters begin.
    lines = [words[k:k + _LINE] for k in range(0, len(words), _LINE)]
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for line, found in zip(lines, _tokenizer(path).encode_batch(
            [" ".join(line) for line in lines], add_special_tokens=False), strict=True):
        size = np.fromiter(map(len, line), np.int64, len(line)) + 1
        at = np.array([begin for begin, _ in found.offsets], np.int64)
        word = np.searchsorted(np.cumsum(size) - size, at, "right") - 1
        ids.append(np.array(found.ids, np.int32))
        counts.append(np.bincount(word, minlength=len(line)))
    return np.concatenate(ids), np.concatenate(counts)


_SIGN = np.zeros(256, bool)
_SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[b for b in range(0x7F) if chr(b).isalnum()]] = True


def _parted(data: np.ndarray, words: W.Words) -> W.Words:
    """Words with the ASCII signs after a last ASCII letter or digit as parts of their own.

    The tokenizer cuts there as well, and lower-cases ASCII, so more parts are equal.
    """
    last = np.maximum.accumulate(np.where(_SIGN[data], -1, np.arange(len(data))))
    cut = last[words.ends - 1] + 1 if len(words.ends) else words.ends
    parted = (cut > words.starts) & (cut < words.ends)
    parted[parted] = _PLAIN[data[cut[parted] - 1]]
    times = 1 + parted.astype(np.int64)
    starts, ends = np.repeat(words.starts, times), np.repeat(words.ends, times)
    second = np.cumsum(times)[parted] - 1
    starts[second] = ends[second - 1] = cut[parted]
    return W.Words(starts, ends, np.repeat(words.text, times))


@lru_cache(maxsize=2)
def _word_table(path: str) -> PieceTable:
    """Parts of words known to this worker, kept for its next tasks."""
    return PieceTable(lambda words: _encode(path, words), KNOWN)


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
           window: int = WINDOW) -> DataFrame:
    """Full windows and rests of all texts, with the checksum of their ids.

    ``place`` is the piece's number within its length and ``part``, the task.
    """
    taken = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def cut(table: PieceTable, block: W.Block):
        """Ids of the block's texts, each distinct part of a word looked up once."""
        data = W.LOWER[block.data]
        parts = _parted(data, W.words(data, block.bounds))
        _, first, which = np.unique(W.span_hashes(data, parts.starts, parts.ends),
                                    return_index=True, return_inverse=True)
        raw = data.tobytes()
        ids, sizes = table.ids([raw[a:b].decode() for a, b in zip(
            parts.starts[first].tolist(), parts.ends[first].tolist(), strict=True)])
        starts = np.cumsum(sizes) - sizes
        ids = ids[ranges(starts[which], sizes[which])]
        total = np.concatenate([[0], np.cumsum(sizes[which])])
        bounds = total[np.searchsorted(parts.text, np.arange(len(block.bounds)))]
        for i in range(len(block.bounds) - 1):
            whole = np.append(ids[bounds[i]:bounds[i + 1]], END).astype("<u4")
            for start in range(0, len(whole), window):
                piece = whole[start:start + window]
                yield i, start, len(piece), zlib.crc32(piece.tobytes()), len(whole)

    def run(batches):
        table = _word_table(tokenizer)
        part, counter = TaskContext.get().partitionId(), Counter(window + 1)
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                row, start, length, crc, tokens = (
                    np.array(x, np.int64) for x in zip(*cut(table, block), strict=True))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row + block.row)), pa.array(start),
                    pa.array(length), pa.array(crc), pa.array(tokens),
                    pa.array(counter.places(length)),
                    pa.array(np.full(len(row), part, np.int32))], names=names)

    schema = StructType(list(taken.select("doc_id").schema.fields))
    for name in ("start", "length", "ids_crc32", "doc_tokens", "place"):
        schema = schema.add(name, "long")
    schema = schema.add("part", "integer")
    names = schema.names
    return taken.mapInArrow(run, schema)


# -- plan ---------------------------------------------------------------------

class Pattern(NamedTuple):
    """Lengths of a window, each with its number of pieces, and how many windows."""

    lengths: tuple[tuple[int, int], ...]
    repeat: int


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to write ``units`` as a falling sum of at most ``depth`` numbers."""
    found: list[tuple[int, ...]] = []

    def extend(above: tuple[int, ...], left: int) -> None:
        if not left:
            found.append(above)
        elif len(above) < depth:
            slots = depth - len(above)
            for x in range(min(left, above[-1] if above else left), -(-left // slots) - 1, -1):
                extend((*above, x), left - x)

    extend((), units)
    return found


def non_negative_least_squares(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``x >= 0`` that brings ``matrix @ x`` closest to ``target``, by active sets."""
    columns = matrix.shape[1]
    x, passive = np.zeros(columns), np.zeros(columns, bool)
    gradient = matrix.T @ target
    limit = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(3 * columns):
        free = np.where(passive, -np.inf, gradient)
        if not columns or free.max() <= limit:
            break
        passive[int(free.argmax())] = True
        while True:
            trial = np.zeros(columns)
            trial[passive] = np.linalg.lstsq(matrix[:, passive], target, rcond=None)[0]
            bad = passive & (trial <= 0)
            if not bad.any():
                break
            step = (x[bad] / np.maximum(x[bad] - trial[bad], 1e-300)).min()
            x += step * (trial - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = trial
        gradient = matrix.T @ (target - matrix @ x)
    return x


def plan(histogram: np.ndarray, window: int = WINDOW, bins: int = BINS,
         depth: int = DEPTH) -> list[Pattern]:
    """Patterns that use up the counts of ``histogram`` (by length, up to the window)."""
    left = histogram.astype(np.int64).copy()
    patterns = []
    if left[window]:
        patterns.append(Pattern(((window, 1),), int(left[window])))
        left[window] = 0
    patterns += _by_least_squares(left, window, min(bins, window), depth)
    return patterns + _greedy(left, window)


def _by_least_squares(left: np.ndarray, window: int, bins: int, depth: int) -> list[Pattern]:
    width = -(-window // bins)
    units = window // width
    by_bin = np.zeros(units + 1)
    # The last unit may be too narrow for a bin: lengths beyond stay for the greedy part.
    at = -(-np.arange(window) // width)
    np.add.at(by_bin, at[at <= units], left[:window][at <= units])
    ways = [w for w in combinations(units, depth) if all(by_bin[x] for x in w)]
    if not ways:
        return []
    matrix = np.zeros((units + 1, len(ways)))
    for j, way in enumerate(ways):
        for x in way:
            matrix[x, j] += 1
    repeats = np.floor(non_negative_least_squares(matrix, by_bin) + 1e-6).astype(np.int64)
    patterns = []
    for j in np.argsort(-repeats, kind="stable"):
        todo = int(repeats[j])
        while todo > 0:
            lengths: dict[int, int] = {}
            for x in ways[j]:
                # The longest left in the bin wastes least.
                span = np.arange(x * width, (x - 1) * width, -1)
                free = [n for n in span if 0 < n < window and left[n] > lengths.get(n, 0)]
                if not free:
                    break
                lengths[int(free[0])] = lengths.get(int(free[0]), 0) + 1
            else:
                times = min(todo, *(int(left[n]) // m for n, m in lengths.items()))
                for n, m in lengths.items():
                    left[n] -= m * times
                patterns.append(Pattern(tuple(lengths.items()), times))
                todo -= times
                continue
            break  # rounding of another combination used the bin up
    return patterns


def _greedy(left: np.ndarray, window: int) -> list[Pattern]:
    patterns = []
    while left.any():
        present = np.flatnonzero(left)
        lengths, room, times = [], window, None
        while room > 0:
            k = int(np.searchsorted(present, room, "right")) - 1
            if k < 0:
                break
            n = int(present[k])
            m = min(room // n, int(left[n]))
            most = int(left[n]) // m
            times = most if times is None else min(times, most)
            lengths.append((n, m))
            room -= n * m
            present = present[:k]
        for n, m in lengths:
            left[n] -= m * times
        patterns.append(Pattern(tuple(lengths), times))
    return patterns


class Slots(NamedTuple):
    """The plan by length: where the pieces from a certain number on go."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray

    def find(self, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these numbers within their length."""
        base = np.searchsorted(self.length, length)
        at, upper = base, np.searchsorted(self.length, length, "right")
        # The last slot of the length that begins at or before the place.
        low, high = at.copy(), upper.copy()
        while (todo := high - low > 1).any():
            middle = (low + high) // 2
            right = todo & (self.first[np.minimum(middle, len(self.first) - 1)] <= place)
            low = np.where(right, middle, low)
            high = np.where(todo & ~right, middle, high)
        within = place - self.first[low]
        return (self.sequence[low] + within // self.each[low],
                self.offset[low] + within % self.each[low] * length)


def slots(patterns: list[Pattern]) -> Slots:
    """The patterns' windows numbered from 0, listed by length."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern in patterns:
        offset = 0
        for n, m in pattern.lengths:
            first = used.get(n, 0)
            rows.append((n, first, sequence, offset, m))
            used[n] = first + m * pattern.repeat
            offset += n * m
        sequence += pattern.repeat
    rows.sort()
    return Slots(*(np.array([r[i] for r in rows], np.int64) for i in range(5)))


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
         window: int = WINDOW) -> DataFrame:
    """One row per piece with its sequence and offset."""
    cut = settle(pieces(docs, tokenizer, doc_id, text, window), "pieces")
    # At most one row per length.
    counted = cut.groupBy("length").agg(F.count(F.lit(1)).alias("pieces")).collect()
    histogram = np.zeros(window + 1, np.int64)
    for row in counted:
        histogram[row["length"]] = row["pieces"]
    where = slots(plan(histogram, window))
    numbered = placed(cut, "length", "part", "place")
    schema = (StructType(list(numbered.drop("place").schema.fields))
              .add("sequence_id", "long").add("offset", "long"))

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset = where.find(length, batch.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in schema.names[:-2]], pa.array(sequence),
                 pa.array(offset)], names=schema.names)

    return numbered.mapInArrow(run, schema)
