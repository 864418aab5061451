"""Words of whole texts as numpy arrays, one block of texts at a time.

A word is a longest run of bytes other than space and ``\\x09`` to ``\\x0d``.
Texts come as Arrow columns; a null text counts as empty. A block holds about
``BLOCK_BYTES`` of text, or one longer text, so memory follows the longest text
and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wardflow.llm.carried import Carried

# A byte takes some fifty bytes of arrays while its block is worked on.
BLOCK_BYTES = 1 << 19
# Text of a batch whose results are made and sent together.
SLICE_BYTES = 1 << 22
# A word beyond this many bytes is hashed by itself.
_SEGMENT = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


class Block(NamedTuple):
    """Some texts of a batch: the first one's row, their bytes, their bounds."""

    row: int
    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Byte range of each word and the text it stands in."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = np.uint64(0xA0761D6478BD642F)
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(_SEGMENT + 1, base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the bounds of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8),
            bounds.astype(np.int64))


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column in order, cut into blocks between texts."""
    data, bounds = text_bytes(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        stop = int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield Block(row, data[bounds[row]:bounds[stop]], bounds[row:stop + 1] - bounds[row])
        row = stop


def words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = _SEPARATOR) -> Words:
    """All words; none reaches over the bounds of a text.

    ``separators``: a mark for each byte that is not part of a word.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    separator = separators[data]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, separator[:-1]
    before[cuts] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, separator[1:]
    after[cuts - 1] = True
    inside = ~separator
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return Words(starts, ends, np.searchsorted(bounds, starts, "right") - 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend without overlap."""
    out = np.zeros(len(starts), np.uint64)
    power, inverse = _power_tables()
    i = 0
    while i < len(starts):
        low = int(starts[i])
        if ends[i] - low > _SEGMENT:
            digest = hashlib.blake2b(data[low:ends[i]].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(digest, np.uint64)[0]
            i += 1
            continue
        j = int(np.searchsorted(ends, low + _SEGMENT, "right"))
        n = int(ends[j - 1]) - low
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[low:low + n]] * power[:n], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _LENGTH
        i = j
    return mix(out)


def window_hashes(word: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` words within a text, and its first word."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:n] == text[width - 1:])
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total = mix(total + word[at + k]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(total + np.uint64(width)), at


def per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set marks (one per byte) in each text."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return np.diff(total[bounds])


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs twice or more, and whether it did before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    ranked = keys[order]
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice, earlier = np.empty(len(keys), bool), np.empty(len(keys), bool)
    twice[order] = same[1:] | same[:-1]
    earlier[order] = same[:-1]
    return twice, earlier


def _cuts(column: pa.Array, size: int) -> list[int]:
    """Rows at which a text column is cut into stretches of about ``size`` bytes."""
    n = len(column)
    if not n or not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        return [0, n]
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + n + 1]
    cuts = [0]
    while cuts[-1] < n:
        stop = int(np.searchsorted(at, int(at[cuts[-1]]) + size, "right")) - 1
        cuts.append(min(n, max(stop, cuts[-1] + 1)))
    return cuts


def add_struct(df: DataFrame, text: str, name: str, fields: StructType,
               compute: Callable[[pa.Array], list]) -> DataFrame:
    """``df`` with a struct column made from the whole texts of a batch.

    ``compute`` gets the text column and returns one array per field. A column
    of that name is replaced; all others pass unchanged, whatever their names.
    """
    carried = Carried(df)
    kept = [i for i, c in enumerate(carried.names) if c != name]
    at = carried.names.index(text)
    # The text is sent once; last, if it bears the name of the result and goes.
    sent = kept if at in kept else [*kept, at]
    taken = carried.rows.select(*[f"c{i}" for i in sent])
    column, keep = sent.index(at), len(kept)
    schema = StructType(taken.schema.fields[:keep]).add("_out", fields)
    arrow = to_arrow_schema(schema)
    kind = arrow.field("_out").type

    def run(batches):
        for batch in (whole.slice(a, b - a) for whole in batches
                      for a, b in pairwise(_cuts(whole.column(column), SLICE_BYTES))):
            made = [pa.array(x, type=kind.field(i).type)
                    for i, x in enumerate(compute(batch.column(column)))]
            out = pa.StructArray.from_arrays(made, fields=[kind.field(i) for i in
                                                           range(kind.num_fields)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], out], schema=pa.schema(
                [*[batch.schema.field(i) for i in range(keep)], pa.field("_out", kind)]))

    result = taken.mapInArrow(run, schema)
    return result.select(*[F.col(f"c{i}").alias(carried.names[i]) for i in kept],
                         F.col("_out").alias(name))


def joined(parts: list[list[np.ndarray]], types: list) -> list[np.ndarray]:
    """The blocks' arrays, field by field, as one array each."""
    return [np.concatenate([p[i] for p in parts]).astype(t) if parts else np.zeros(0, t)
            for i, t in enumerate(types)]
