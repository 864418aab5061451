"""Join of documents by the Jaccard similarity of their word shingles.

Size-aware, heavy-light. Two sets that link share at least ``k`` shingles among
the first ``n - ceil(t * n) + k`` of each, in any order common to all sets
(``n``: the set's size, ``t``: the similarity). So

* a *small* set is entered under every pair (``k = 2``) of its first shingles,
* a *large* set under each of its first shingles (``k = 1``), an inverted list
  that is scanned; small sets near the boundary are in those lists as well,

and sets that share an entry are compared exactly. The boundary is the size at
which a pair enumeration costs more than the lists' scan, both summed over the
counted sizes and lists of all documents. The common order is by hash, with the
most frequent shingles last, so that passages found in many documents lie behind
the rare shingles. Any order gives the same links; only the work differs.

Documents with equal sets form one class, which is compared once; copies are
never paired. In each entry, all sets are first compared with the one that
occurs in most entries. Sets that are connected by then need no more pairs; every
other pair of an entry is compared in a second round. So the classes are exact,
and no pairs are made within a large group of near copies. That round scans the
lists in blocks of ``LIST_BLOCK`` sets, which carry their parity bits: the pairs
of two blocks are formed and ruled out in a task, and only pairs near enough leave
it. So a list of any length is cut into tasks of equal size. A document's number of
links needs every pair: then all pairs of an entry are compared, and the links of
a set are weighted by the copies of the sets it links with.

A set is named by a 64-bit hash that covers its shingles and size, and shingles
are compared by 64-bit hashes.

Defined results: a null, empty or blank text has 0 shingles and links with
nothing; under five words the whole sequence is one shingle. A null id takes
part in links, but is never a class's id unless there is no other. Equal rows
give equal results, each its own row. Texts and sets of any size are compared
whole. Other columns, whatever their names, are not read, or pass; an empty table gives
an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from wardflow.llm import words as W
from wardflow.llm.carried import Carried
from wardflow.llm.components import components
from wardflow.session import settle

WIDTH = 5
SIMILARITY = 80
# Entries in the list of the most frequent shingles, which bounds its broadcast,
# and the count from which a shingle may be listed.
MAX_FREQUENT = 1 << 16
FREQUENT = 8
# Bits of the filter that spares most documents the shuffle of their sets.
FILTER_BITS = 26
_SEEN = 1 << 18
# Passes over the texts in which frequent shingles may still be found, that of the
# entries included.
PASSES = 3
# Sets of a list that are compared with as many others at a time.
LIST_BLOCK = 256
# Rows of units that are taken at a time, and rows of a unit that is not taken alone.
_UNIT_ROWS = 1 << 14
_SMALL_UNIT = 16
# Words of 64 parity bits that are compared at a time.
_PARITY_WORDS = 1 << 20

_SET = (StructType().add("n_shingles", LongType()).add("set_id", LongType())
        .add("parities", BinaryType()))


def _least(n, similarity: int):
    """Smallest overlap a set of this size can have with one it links with."""
    return -(-similarity * n // 100)


def _shingles(block: W.Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingles of the block's texts, by text and hash, and their bounds."""
    data = W.LOWER[block.data]
    n = len(block.bounds) - 1
    found = W.words(data, block.bounds)
    word = W.span_hashes(data, found.starts, found.ends)
    count = np.bincount(found.text, minlength=n)
    shingle, at = W.window_hashes(word, found.text, width)
    text = found.text[at]
    short = [(shingle, text)]
    for k in range(1, width):
        own = count[found.text] == k
        if own.any():
            whole, first = W.window_hashes(word[own], found.text[own], k)
            short.append((whole, found.text[own][first]))
    shingle = np.concatenate([x for x, _ in short])
    text = np.concatenate([x for _, x in short])
    order = np.argsort(shingle)
    small = np.uint16 if n < 1 << 16 else np.int64
    order = order[np.argsort(text[order].astype(small), kind="stable")]
    shingle, text = shingle[order], text[order]
    first = np.ones(len(shingle), bool)
    first[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    shingle, text = shingle[first], text[first]
    return shingle, np.searchsorted(text, np.arange(n + 1))


def _set_ids(shingle: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and name of each text's set."""
    total = np.zeros(len(shingle) + 1, np.uint64)
    np.cumsum(W.mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    n = np.diff(bounds)
    name = W.mix(total[bounds[1:]] - total[bounds[:-1]] + W.mix(n.astype(np.uint64) + np.uint64(1)))
    return n, name.view(np.int64)


def with_sets(docs: DataFrame, text: str = "text", name: str = "shingles",
              width: int = WIDTH) -> DataFrame:
    """``docs`` with size, name and parity bits of each text's set; no name for none."""
    def compute(column: pa.Array) -> list:
        parts = []
        for block in W.blocks(column):
            shingle, bounds = _shingles(block, width)
            bits = [_parities(shingle[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            parts.append([*_set_ids(shingle, bounds), np.array([*bits, None], object)[:-1]])
        n, names, bits = W.joined(parts, [np.int64, np.int64, object])
        return [n, pa.array(names, mask=n == 0), bits]

    return W.add_struct(docs, text, name, _SET, compute)


def _each_set(docs: DataFrame, text: str, width: int, schema: str, fields: list, emit) -> DataFrame:
    """Rows made from the sets, each set at most once in a stretch of a task.

    ``emit`` gets the block's shingles, bounds, sizes, names and the texts to
    take, and returns one array per field.
    """
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for block in W.blocks(batch.column(0)):
                shingle, bounds = _shingles(block, width)
                n, names = _set_ids(shingle, bounds)
                take = []
                for i in np.flatnonzero(n):
                    if int(names[i]) not in seen:
                        seen.add(int(names[i]))
                        take.append(i)
                if len(seen) > _SEEN:
                    seen.clear()
                if take:
                    made = emit(shingle, bounds, n, names, np.array(take))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, type=f.type) for x, f in zip(made, fields, strict=True)],
                        schema=pa.schema(fields))

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, schema)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of several ranges after each other, and the range of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[owner] + within, owner


def _shingle_counts(docs: DataFrame, text: str, width: int, similarity: int) -> DataFrame:
    """Keys of shingles that stand among the first, by hash, of two or more sets."""
    def emit(shingle, bounds, n, names, take):
        prefix = n[take] - _least(n[take], similarity) + 1
        at, _ = _ranges(bounds[take], prefix)
        return [W.mix(shingle[at]).view(np.int64)]

    first = _each_set(docs, text, width, "key long", [pa.field("key", pa.int64())], emit)
    return settle(first.groupBy("key").agg(F.count(F.lit(1)).alias("sets"))
                  .filter("sets > 1"), "shingle-counts")


def _boundary(sets: DataFrame, counts: DataFrame, listed: np.ndarray, similarity: int) -> int:
    """Largest size at which sets are entered by pairs, chosen by cost.

    Up to the boundary a set costs an entry per pair of its first shingles, beyond
    it an entry and a list's mean length per first shingle. ``listed``: the counts
    of the frequent shingles, which are put last and so make no lists. Sizes are
    counted in steps of an eighth, so the histogram is small.
    """
    size = F.floor(F.pow(F.lit(2.0), F.floor(F.log2("n_shingles") * 6) / 6)).cast("long")
    histogram = (sets.filter("n_shingles > 0").groupBy(size.alias("size"))
                 .agg(F.count(F.lit(1)).alias("sets")).orderBy("size").collect())
    shared, scanned = counts.agg(F.sum("sets"), F.sum(F.col("sets") * F.col("sets"))).first()
    steps = (scanned or 0) - (shared or 0) - int((listed * (listed - 1)).sum())
    prefix = [(r["size"], r["size"] - _least(r["size"], similarity) + 1, r["sets"])
              for r in histogram]
    entries = sum(p * c for _, p, c in prefix)
    scan = 1 + steps / max(entries, 1)
    pairs = [c * (p + 1) * p / 2 for _, p, c in prefix]
    lists = [c * p * scan for _, p, c in prefix]
    costs = [sum(pairs[:i]) + sum(lists[i:]) for i in range(len(prefix) + 1)]
    best = int(np.argmin(costs))
    return prefix[best - 1][0] if best else 0


def _entries(docs: DataFrame, text: str, width: int, similarity: int, frequent: np.ndarray,
             order: np.ndarray, boundary: int) -> tuple[DataFrame, DataFrame]:
    """``key``, ``set_id`` and size of every entry, and the shingles from there on.

    ``hot`` marks the entries made of frequent shingles only. The second table has the
    keys of the other shingles that stand among the first of a set, but do not by hash.
    """
    def ordered(shingle, bounds, n, take):
        """Shingles by the common order, whether they are listed, and their places by hash."""
        at, owner = _ranges(bounds[take], n[take])
        token = shingle[at]
        key = W.mix(token)
        place = np.minimum(np.searchsorted(frequent, key), max(len(frequent) - 1, 0))
        listed = frequent[place] == key if len(frequent) else np.zeros(len(token), bool)
        rank = np.where(listed, order[place] + 1 if len(order) else 0, 0)
        # By rank within each set; unlisted ones have rank 0 and stay by hash.
        moved = np.lexsort((rank, owner))
        return token[moved], listed[moved], moved

    def singles(size):
        """Places and numbers of first shingles, and the sets entered under single ones."""
        start = np.cumsum(size) - size
        prefix = size - _least(size, similarity) + 1
        # Sets that can link with one beyond the boundary.
        return start, prefix, np.flatnonzero(100 * size > similarity * boundary)

    def forward(shingle, bounds, n, names, take):
        token, listed, by_hash = ordered(shingle, bounds, n, take)
        start, prefix, single = singles(n[take])
        i, who = _ranges(start[single], prefix[single])
        i = i[~listed[i] & (by_hash[i] >= (start + prefix)[single][who])]
        return [W.mix(token[i]).view(np.int64)]

    def emit(shingle, bounds, n, names, take):
        token, listed, _ = ordered(shingle, bounds, n, take)
        size = n[take]
        start, prefix, single = singles(size)
        keys, sets, heavy, rest = [], [], [], []
        i, who = _ranges(start[single], prefix[single])
        keys.append(W.mix(token[i]))
        sets.append(single[who])
        heavy.append(listed[i])
        rest.append(size[single][who] - (i - start[single][who]))
        small = np.flatnonzero((size <= boundary) & (_least(size, similarity) >= 2))
        for p in np.unique(prefix[small]):
            own = small[prefix[small] == p]
            a, b = np.triu_indices(min(p + 1, int(size[own].min())), 1)
            left, right = (start[own][:, None] + x[None, :] for x in (a, b))
            low = np.minimum(token[left], token[right])
            high = np.maximum(token[left], token[right])
            keys.append(W.mix(W.mix(low + np.uint64(1)) + high).ravel())
            sets.append(np.repeat(own, len(a)))
            heavy.append((listed[left] & listed[right]).ravel())
            rest.append(np.repeat(size[own], len(a)))
        keys, sets = np.concatenate(keys), np.concatenate(sets)
        return [keys.view(np.int64), names[take][sets], size[sets].astype(np.int32),
                np.concatenate(rest).astype(np.int32), np.concatenate(heavy)]

    entries = _each_set(docs, text, width, "key long, set_id long, n int, rest int, hot boolean",
                        [pa.field("key", pa.int64()), pa.field("set_id", pa.int64()),
                         pa.field("n", pa.int32()), pa.field("rest", pa.int32()),
                         pa.field("hot", pa.bool_())], emit)
    return entries, _each_set(docs, text, width, "key long", [pa.field("key", pa.int64())], forward)


def _shared(entries: DataFrame, similarity: int) -> DataFrame:
    """Entries of keys that two or more sets share, and all distinct entries of hot keys.

    One shuffle; the sorted rows of a task are then read once. A hot key's entries are
    spread over all tasks by set, so none tells how many sets share the key. Of the others,
    entries that may link with none of their key are left out, if it has few.
    """
    def run(batches):
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if left is None else [left, batch])
            table = table.combine_chunks()
            if not len(table):
                continue
            key = table["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on
            left = table.slice(last).to_batches()[0]
            yield from _several(table.slice(0, last), similarity)
        if left is not None:
            yield from _several(pa.Table.from_batches([left]), similarity)

    spread = F.when(F.col("hot"), F.col("set_id")).otherwise(F.lit(0))
    dealt = entries.repartition("key", spread).sortWithinPartitions("key", "set_id")
    return dealt.mapInArrow(run, entries.schema)


def _several(table: pa.Table, similarity: int):
    if not len(table):
        return
    key, name = table["key"].to_numpy(), table["set_id"].to_numpy()
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    new = head.copy()
    new[1:] |= name[1:] != name[:-1]
    run = np.cumsum(head) - 1
    several = np.bincount(run[new]) > 1
    hot = table["hot"].to_numpy()
    keep = np.flatnonzero(new & (several[run] | hot))
    n, rest = (table[c].to_numpy()[keep].astype(np.int64) for c in ("n", "rest"))
    keep = keep[hot[keep] | _partnered(run[keep], n, rest, similarity)]
    yield from table.take(pa.array(keep)).to_batches()


def _partnered(run: np.ndarray, n: np.ndarray, rest: np.ndarray, similarity: int) -> np.ndarray:
    """Whether each entry may link with another of its run; all entries of long runs."""
    long = np.bincount(run)[run] > _SMALL_UNIT if len(run) else np.zeros(0, bool)
    found = long.copy()
    for d in range(1, _SMALL_UNIT):
        a = np.flatnonzero((run[:-d] == run[d:]) & ~long[:-d])
        if not len(a):
            break
        b = a + d
        near = (_fits(n[a], n[b], similarity)
                & _reaches(n[a], n[b], np.minimum(rest[a], rest[b]), similarity))
        found[a[near]] = True
        found[b[near]] = True
    return found


def _fits(x: np.ndarray, y: np.ndarray, similarity: int) -> np.ndarray:
    """Whether two sets of these sizes can link at all."""
    return 100 * np.minimum(x, y) >= similarity * np.maximum(x, y)


def _reaches(x: np.ndarray, y: np.ndarray, rest: np.ndarray, similarity: int) -> np.ndarray:
    """Whether the shingles from the first common one on are enough for a link."""
    return (100 + similarity) * rest >= similarity * (x + y)


def _may_link(similarity: int) -> Column:
    """Whether the sizes fit, and the shingles from the entry on if it is the first in common.

    A pair that links passes at its first common shingle: all others lie behind it.
    """
    sizes = 100 * F.least("n", "m") >= similarity * F.greatest("n", "m")
    return sizes & ((100 + similarity) * F.least("rest", "other_rest")
                    >= similarity * (F.col("n") + F.col("m")))


def _filter(pairs: DataFrame) -> np.ndarray:
    """Bits of the names in pairs, at most 2**20 words of 64."""
    slot = F.col("name").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = (pairs.select(F.explode(F.array("a", "b")).alias("name"))
            .groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
            .toPandas())
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def _paired_sets(docs: DataFrame, text: str, width: int, pairs: DataFrame) -> DataFrame:
    """The shingles of the sets in pairs (and of few others), one row per set."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(pairs))

    def emit(shingle, bounds, n, names, take):
        slot = names[take].view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
        word = bits.value[(slot >> np.uint64(6)).astype(np.int64)]
        take = take[(word >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return [names[take], [shingle[bounds[i]:bounds[i + 1]].tobytes() for i in take]]

    rows = _each_set(docs, text, width, "set_id long, shingles binary",
                     [pa.field("set_id", pa.int64()), pa.field("shingles", pa.binary())], emit)
    return settle(rows.dropDuplicates(["set_id"]), "paired-sets")


def _parities(shingle: np.ndarray) -> bytes:
    """Two to four bits a shingle: how often, odd or even, each low part occurs."""
    size = 64 << int(len(shingle) // 32).bit_length()
    return np.packbits(np.bincount((shingle & np.uint64(size - 1)).astype(np.int64),
                                   minlength=size).astype(np.uint8) & 1).tobytes()


def _differing(x: np.ndarray, y: np.ndarray) -> int:
    """At most the number of shingles in one set only; the longer parities are folded."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < len(y):
        # packbits keeps the order of bits, so a fold joins equal low parts.
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


class _Parities:
    """Parity bits of a batch of sets, in a matrix for each width."""

    def __init__(self, bits: pa.Array):
        raw = bits.to_pylist()
        self._words = np.array([len(b) // 8 for b in raw])
        self._row = np.zeros(len(raw), np.int64)
        self._matrix = {}
        for w in np.unique(self._words):
            own = np.flatnonzero(self._words == w)
            self._row[own] = np.arange(len(own))
            self._matrix[int(w)] = np.frombuffer(b"".join(raw[i] for i in own),
                                                 np.uint64).reshape(-1, w)

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of sets, at most the number of shingles in one of both only."""
        out = np.zeros(len(i), np.int64)
        swap = self._words[i] > self._words[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        kind = self._words[i] << 32 | self._words[j]
        for k in np.unique(kind):
            own = np.flatnonzero(kind == k)
            short, long = int(k) >> 32, int(k) & 0xFFFFFFFF
            step = max(1, _PARITY_WORDS // long)
            for a in range(0, len(own), step):
                at = own[a:a + step]
                x = self._matrix[short][self._row[i[at]]]
                y = self._matrix[long][self._row[j[at]]]
                if long > short:  # equal low parts lie a whole number of widths apart
                    y = np.bitwise_xor.reduce(y.reshape(len(at), -1, short), axis=1)
                out[at] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


class _Unit:
    """Rows of units after each other, and the pairs in them that may be near."""

    def __init__(self, table: pa.Table, similarity: int):
        (self.key, self.low, self.high, self.block, self.name, self.n, self.rest, self.root) = (
            table.column(c).to_numpy() for c in range(8))
        self._bits, self._similarity = table.column(8).combine_chunks(), similarity

    def _may_link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = self.n[a].astype(np.int64), self.n[b].astype(np.int64)
        least = np.minimum(self.rest[a], self.rest[b]).astype(np.int64)
        keep = ((self.root[a] != self.root[b]) & _fits(x, y, self._similarity)
                & _reaches(x, y, least, self._similarity))
        return a[keep], b[keep]

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        head = np.ones(len(self.key), bool)
        head[1:] = ((self.key[1:] != self.key[:-1]) | (self.low[1:] != self.low[:-1])
                    | (self.high[1:] != self.high[:-1]))
        starts, unit = np.flatnonzero(head), np.cumsum(head) - 1
        sizes = np.diff(np.append(starts, len(head)))
        small, whole = sizes <= _SMALL_UNIT, self.low == self.high
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        # Small units all at once, by the distance of the rows; large ones by themselves.
        for d in range(1, int(sizes[small].max(initial=1))):
            a = np.flatnonzero((unit[:-d] == unit[d:]) & small[unit[:-d]])
            a = a[whole[a] | (self.block[a] != self.block[a + d])]
            found.append(self._may_link(a, a + d))
        for start, size in zip(starts[~small], sizes[~small], strict=True):
            a, b = np.triu_indices(size, 1)
            a, b = a + start, b + start
            if not whole[start]:  # of two blocks only the pairs across
                across = self.block[a] != self.block[b]
                a, b = a[across], b[across]
            found.append(self._may_link(a, b))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return a, b

    def near(self) -> pa.RecordBatch:
        a, b = self._pairs()
        apart = _Parities(self._bits).differing(a, b)
        keep = ((100 + self._similarity) * apart
                <= (100 - self._similarity) * (self.n[a].astype(np.int64) + self.n[b]))
        a, b = self.name[a[keep]], self.name[b[keep]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1)], names=["a", "b"])


def _near_in_lists(entries: DataFrame, similarity: int) -> DataFrame:
    """Pairs of sets that share a list, differ in root, and may link by their parities.

    ``entries``: key, set_id, n, rest, root, parities and ``size``, the number of sets in
    the key's list. A unit is a block of a list, or two blocks of it; a block's rows are
    sent once for each block of its list.
    """
    blocks = F.ceil(F.col("size") / LIST_BLOCK).cast("int")
    cut = entries.withColumn("block", F.pmod(F.xxhash64("set_id"), blocks).cast("int"))
    units = cut.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other")).select(
        "key", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"),
        "block", "set_id", "n", "rest", "root", "parities")
    dealt = units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < _UNIT_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            open_ = np.ones(len(table), bool)  # rows of the last unit, which may go on
            for c in range(3):
                values = table.column(c).to_numpy()
                open_ &= values == values[-1]
            first = int(open_.argmax())
            if first:
                yield _Unit(table.slice(0, first), similarity).near()
            held, rows = table.slice(first).to_batches(), len(table) - first
        if rows:
            yield _Unit(pa.Table.from_batches(held).combine_chunks(), similarity).near()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text: str, width: int,
              similarity: int) -> DataFrame:
    """The pairs whose sets are similar enough, by their exact overlap.

    Parity bits, a thirtieth of the shingles' size, rule out most others first.
    The rest's shingles are made anew from the texts rather than stored for all.
    """
    def may_link(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            apart = np.array([_differing(np.frombuffer(x.as_buffer(), np.uint8),
                                         np.frombuffer(y.as_buffer(), np.uint8))
                              for x, y in zip(left, right, strict=True)], np.int64)
            keep = (100 + similarity) * apart <= (100 - similarity) * total.astype(np.int64)
            yield batch.select([0, 1]).filter(pa.array(keep))

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("set_id").alias(name), *[F.col(c).alias(f"_{c}_{name}")
                                                          for c in columns])

    near = settle(pairs.join(side("a", "parities", "n_shingles"), "a")
                  .join(side("b", "parities", "n_shingles"), "b")
                  .select("a", "b", "_parities_a", "_parities_b", "_n_shingles_a",
                          "_n_shingles_b")
                  .mapInArrow(may_link, "a long, b long"), "near-pairs")
    return _exactly_linked(near, docs, text, width, similarity)


def _exactly_linked(near: DataFrame, docs: DataFrame, text: str, width: int,
                    similarity: int) -> DataFrame:
    """The pairs, a written table, whose shingles overlap enough."""
    def link(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                both = np.concatenate((np.frombuffer(left[i].as_buffer(), np.uint64),
                                       np.frombuffer(right[i].as_buffer(), np.uint64)))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= similarity * (len(both) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))
    if near.isEmpty():
        return near
    sets = _paired_sets(docs, text, width, near)

    def side(name: str) -> DataFrame:
        return sets.select(F.col("set_id").alias(name), F.col("shingles").alias(f"_shingles_{name}"))

    return settle(near.join(side("a"), "a").join(side("b"), "b")
                  .select("a", "b", "_shingles_a", "_shingles_b")
                  .mapInArrow(link, "a long, b long"), "links")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _most(counts: DataFrame, frequent: int) -> pd.DataFrame:
    """The most frequent keys, at most ``MAX_FREQUENT``, with their counts."""
    return (counts.filter(F.col("sets") >= frequent).orderBy(F.desc("sets"), "key")
            .limit(MAX_FREQUENT).toPandas())


def _worth(sets: pd.Series | np.ndarray, pass_cost: int) -> bool:
    """Whether lists of these lengths cost more to scan than a pass over the entries."""
    length = np.asarray(sets, np.float64)
    return bool((length * length).sum() > pass_cost)


def set_links(docs: DataFrame, sets: DataFrame, text: str = "text", width: int = WIDTH,
              similarity: int = SIMILARITY, boundary: int | None = None,
              frequent: int = FREQUENT, every: bool = False) -> DataFrame:
    """Links (``a``, ``b``) between similar sets, each verified.

    ``sets``: the distinct sets, with size and parity bits. ``every``: all links, else
    enough to connect the classes, in which sets may be connected through others.
    """
    counts = _shingle_counts(docs, text, width, similarity)
    listed = _most(counts, frequent)
    if boundary is None:
        boundary = _boundary(sets, counts, listed["sets"].to_numpy(np.int64), similarity)

    def entries() -> tuple[DataFrame, DataFrame]:
        by_key = listed.sort_values("key", key=lambda k: k.to_numpy(np.int64).view(np.uint64))
        key = by_key["key"].to_numpy(np.int64).view(np.uint64)
        order = np.empty(len(key), np.int64)
        order[np.lexsort((key, by_key["sets"].to_numpy(np.int64)))] = np.arange(len(key))
        return _entries(docs, text, width, similarity, key, order, boundary)

    # With some shingles put last, others come to the front that were not counted
    # there before: they are listed too, as long as their lists, if scanned, would
    # cost more than another pass over all first shingles. Only those are counted, so
    # the entries are dealt once however often the list grows.
    size = F.col("n_shingles")
    first = size - F.ceil(F.lit(similarity) * size / 100) + 1
    pass_cost = sets.filter(size > 0).agg(F.sum(first)).first()[0] or 0
    for left in reversed(range(PASSES)):
        made, forward = entries()
        if not left:
            break
        more = _most(forward.groupBy("key").agg(F.count(F.lit(1)).alias("sets")), frequent)
        if not _worth(more["sets"], pass_cost):
            break
        listed = (pd.concat([listed, more]).sort_values(["sets", "key"], ascending=[False, True])
                  .head(MAX_FREQUENT))

    shared = settle(_shared(made, similarity), "shared-entries")
    light = shared.filter("NOT hot").drop("hot")
    hot = shared.filter("hot").drop("hot")
    hot_keys = settle(hot.groupBy("key").agg(F.min("set_id").alias("_a"), F.max("set_id").alias("_b"))
                      .filter("_a <> _b").select("key"), "hot-keys")
    members = settle(light.unionByName(hot.join(hot_keys, "key", "left_semi")), "members")

    if every:
        # Copies of the sides' columns: a table joined with itself.
        other = members.select("key", F.col("set_id").alias("other"), F.col("n").alias("m"),
                               F.col("rest").alias("other_rest"))
        every_pair = (members.join(other, "key").filter("set_id < other")
                      .filter(_may_link(similarity))
                      .select(F.col("set_id").alias("a"), F.col("other").alias("b")).distinct())
        return _verified(settle(every_pair, "every-pair"), sets, docs, text, width, similarity)

    # The set in most entries stands for the entry: an unchanged original rather
    # than one of its altered copies.
    weights = settle(members.groupBy("set_id").agg(F.count(F.lit(1)).alias("weight")), "weights")
    weighted = settle(members.join(weights, "set_id"), "weighted")
    pivots = settle(weighted.groupBy("key").agg(
        F.max(F.struct("weight", "set_id", "n", "rest")).alias("p"))
        .select("key", F.col("p.set_id").alias("pivot"), F.col("p.n").alias("m"),
                F.col("p.rest").alias("other_rest")), "pivots")
    pairs = settle(members.join(pivots, "key").filter("set_id <> pivot")
                   .filter(_may_link(similarity))
                   .select(*_ordered("set_id", "pivot")).distinct(), "pairs")
    links = _verified(pairs, sets, docs, text, width, similarity)
    roots = components(links)

    rooted = settle(members.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
                    .withColumn("root", F.coalesce("root", "set_id")), "rooted")
    open_keys = settle(rooted.groupBy("key").agg(
        F.min("root").alias("_a"), F.max("root").alias("_b"), F.count(F.lit(1)).alias("size"))
        .filter("_a <> _b").select("key", "size"), "open-keys")
    rest = (rooted.join(open_keys, "key")
            .join(sets.select("set_id", "parities"), "set_id"))
    near = settle(_near_in_lists(rest, similarity).join(pairs, ["a", "b"], "left_anti"),
                  "more-near-pairs")
    return links.unionByName(_exactly_linked(near, docs, text, width, similarity))


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   width: int = WIDTH, similarity: int = SIMILARITY,
                   boundary: int | None = None, frequent: int = FREQUENT,
                   count_links: bool = True) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``set_id``, ``component_id``, ``n_links``.

    ``n_links``: the other documents it is similar to, copies included. Without
    ``count_links`` there is no such column and fewer links are made; the classes are the same.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = settle(with_sets(docs, width=width).select("doc_id", "shingles.*"), "sets")
    sets = settle(named.filter("n_shingles > 0").groupBy("set_id", "n_shingles")
                  .agg(F.min("doc_id").alias("first_id"), F.first("parities").alias("parities"),
                       F.count(F.lit(1)).alias("copies")),
                  "distinct-sets")
    links = set_links(docs, sets, "text", width, similarity, boundary, frequent, count_links)
    roots = components(links)
    rooted = (sets.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
              .select("set_id", F.coalesce("root", "set_id").alias("root"), "first_id"))
    rooted = settle(rooted, "set-roots")
    first = settle(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")),
                   "root-ids")
    classes = settle(rooted.join(first, "root").select("set_id", "component_id"), "classes")
    columns = ["doc_id", "n_shingles", "set_id", F.when(F.col("set_id").isNull(), F.col("doc_id"))
               .otherwise(F.col("component_id")).alias("component_id")]
    if count_links:
        # Copies are counted, not paired.
        both = links.select("a", "b").unionByName(
            links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        linked = (both.join(sets.select(F.col("set_id").alias("b"), "copies"), "b")
                  .groupBy(F.col("a").alias("set_id")).agg(F.sum("copies").alias("_others")))
        numbers = settle(sets.select("set_id", "copies").join(linked, "set_id", "left").select(
            "set_id", (F.coalesce("_others", F.lit(0)) + F.col("copies") - 1).alias("_links")),
            "link-counts")
        classes = classes.join(numbers, "set_id")
        columns.append(F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))
    return named.join(classes, "set_id", "left").select(*columns)


def one_of_each(docs: DataFrame, similarity: int = SIMILARITY, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``docs`` with one row of each class, in the same columns, whatever their names.

    The row with the smallest id stays, of equal ids one of them. Documents
    without words all stay.
    """
    carried = Carried(docs)
    key, column = carried[doc_id], carried[text]
    joined = settle(join_documents(carried.rows, key, column, similarity=similarity,
                                   count_links=False), "joined")
    chosen = (joined.filter("set_id IS NOT NULL")
              .groupBy("set_id", "component_id").agg(F.min("doc_id").alias("first_id"))
              # A class without any id is its set alone or has none to choose by.
              .filter(F.col("first_id").eqNullSafe(F.col("component_id"))))
    by_class = Window.partitionBy("component_id").orderBy("set_id")
    with_id = chosen.filter("component_id IS NOT NULL").withColumn(
        "_n", F.row_number().over(by_class)).filter("_n = 1").select("set_id")
    chosen = settle(with_id.unionByName(
        chosen.filter("component_id IS NULL").select("set_id")), "chosen")
    named = (with_sets(carried.rows, column, "_shingles")
             .withColumn("_set", F.col("_shingles.set_id")).drop("_shingles"))
    order = Window.partitionBy("_set").orderBy(F.col(key).asc_nulls_last())
    first = (named.join(chosen.withColumnRenamed("set_id", "_set"), "_set", "left_semi")
             .withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n"))
    return carried.back(first.unionByName(named.filter("_set IS NULL")))
