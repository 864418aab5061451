"""An n-gram model in Elias-Fano levels, built and queried by Spark tasks.

Level 1 holds the words of the training texts: their 64-bit hashes as a rising
sequence, with exact counts. A word's number is its place. Level k holds the
n-grams of k words seen ``min_count`` times or more, as children of the n-gram
of their first k - 1 words: rising numbers of the parents, rising pointers to
their first children, and the children's words made rising by adding the
parent's place. A child is found by a successor search relative to its parent.
Levels are cut into shards by a hash of the parent, files that tasks map into memory.
Contexts seen ``HEAVY`` times or more have shards of their own, by a hash of parent
and word, so a frequent context is spread over all of them.

Smoothing is interpolated absolute discounting: ``p(w | v u) = (c(v u w) - D) /
c(v u) + g(v u) p(w | u)`` with ``g`` such that all words of a context, unseen
ones included, sum to one. Below two words it is the additive unigram estimate.
The first term and ``g`` are stored in 8 bits of their logarithm.

``min_count=1`` keeps every n-gram, as the query does. By default those of two
words and more that were seen once are left out; words never are. All counts come
from all training rows.

Defined results: a null or empty text is the end token alone. A null id is held
out. Repeated rows are counted and scored each.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from wardflow.llm import words as W
from wardflow.llm.elias_fano import EliasFano, encode
from wardflow.llm.files import read_arrays, write_arrays
from wardflow.session import run_dir, settle

ORDER = 3
MIN_COUNT = 2
DISCOUNT = 0.75
ADDED = 0.1
SHARD_ROWS = 1 << 21
# A context seen as often is spread over several shards.
HEAVY = 1 << 18
_END = int(W.mix(np.array([0x656E64], np.uint64))[0])
# N-grams of a task that are counted together before they are sent.
_HELD = 1 << 21
# Text taken at a time, as much as is sent together: every block asks every shard, so small
# ones cost more.
BLOCK_BYTES = W.SLICE_BYTES
_FIELDS = (StructType().add("n_tokens", LongType()).add("n_known", LongType())
           .add("base_score", DoubleType()).add("score", DoubleType()))


class Model(NamedTuple):
    """Where the levels are and the numbers that all of them share."""

    path: str
    order: int
    shards: tuple[int, ...]  # by level; from level 2 on as many again for heavy contexts
    firsts: tuple[int, ...]  # first word number of each shard of level 1
    bases: tuple[tuple[int, ...], ...]  # first n-gram number of each shard, by level from 2
    heavy: tuple[bool, ...]  # whether the level has heavy contexts, by level from 2
    words: int
    tokens: int
    texts: int
    min_count: int = MIN_COUNT


def held_out(doc_id: Column) -> Column:
    """Whether a row's id keeps it from being learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _quantised(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Logarithms in 8 bits, evenly spaced between the least and the greatest."""
    logs = np.log10(np.maximum(values, 1e-12))
    low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
    step = (high - low) / 255 or 1.0
    return {f"{name}.codes": np.rint((logs - low) / step).astype(np.uint8),
            f"{name}.scale": np.array([low, step])}


def _restored(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    low, step = arrays[f"{name}.scale"]
    return (10.0 ** (low + step * np.arange(256)))[arrays[f"{name}.codes"][at]]


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (W.mix(key) % np.uint64(shards)).astype(np.int64)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of equal values in which each stands, and the first of each run."""
    head = np.ones(len(values), bool)
    head[1:] = values[1:] != values[:-1]
    return np.cumsum(head) - 1, np.flatnonzero(head)


def _small(values: np.ndarray) -> np.ndarray:
    """Counts in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


class _Shard:
    """Children of many parents: numbers and first terms, and the parents' ``g``."""

    def __init__(self, arrays: dict[str, np.ndarray], words: int):
        self.arrays, self._words = arrays, words
        self._parents = EliasFano(arrays, "parents")
        self._pointers = EliasFano(arrays, "pointers")
        self._children = EliasFano(arrays, "children")

    def left(self, place: np.ndarray) -> np.ndarray:
        """``g`` of the parents in these places, 1 for one without children (-1)."""
        out = np.ones(len(place))
        known = place >= 0
        out[known] = _restored(self.arrays, "left", place[known])
        return out

    def find(self, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each child in the shard and that of its parent, or -1."""
        # A parent's children stand together, so it is looked up once.
        run, first = _runs(parent)
        place, known = self._parents.successor(parent[first])
        place = np.where(known, place, -1)[run]
        out = np.full(len(parent), -1, np.int64)
        own = np.flatnonzero(place >= 0)
        # Relative to its parent's place a child's number is unique in the shard.
        at, found = self._children.successor(
            place[own].astype(np.uint64) * np.uint64(self._words) + word[own].astype(np.uint64))
        out[own[found]] = at[found]
        return out, place


class Levels:
    """The levels of a model as a task sees them: files are opened when needed."""

    def __init__(self, model: Model):
        self.model = model
        self._files: dict[tuple[str, int, int], object] = {}

    def _open(self, kind: str, level: int, shard: int):
        key = (kind, level, shard)
        if key not in self._files:
            arrays = read_arrays(f"{self.model.path}/{kind}-{level}-{shard}")
            self._files[key] = (_Shard(arrays, self.model.words + 1) if kind == "ngrams"
                                else arrays if kind == "counts"
                                else (EliasFano(arrays, "keys"), arrays))
        return self._files[key]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (or -1) and count of each word; hashes rise."""
        number = np.full(len(hashes), -1, np.int64)
        count = np.zeros(len(hashes), np.int64)
        shards = self.model.shards[0]
        shift = np.uint64(64 - (shards - 1).bit_length())
        part = (hashes >> shift).astype(np.int64) if shards > 1 else np.zeros(len(hashes), np.int64)
        bounds = np.searchsorted(part, np.arange(shards + 1))
        mask = np.uint64((1 << int(shift)) - 1) if shards > 1 else np.uint64(2 ** 64 - 1)
        for s in range(shards):
            own = slice(bounds[s], bounds[s + 1])
            if bounds[s] < bounds[s + 1]:
                keys, arrays = self._open("words", 1, s)
                at, found = keys.successor((hashes[own] & mask) >> np.uint64(1))
                # The sequence leaves the last bit out; it is kept beside.
                for ahead in (0, 1):
                    here = np.minimum(at + ahead, max(keys.n - 1, 0))
                    if keys.n:
                        same = keys.access(here) == (hashes[own] & mask) >> np.uint64(1)
                        same &= arrays["bit"][here] == (hashes[own] & np.uint64(1))
                        same &= at + ahead < keys.n
                        number[own] = np.where(same, here + self.model.firsts[s], number[own])
                        count[own] = np.where(same, arrays["counts"][here], count[own])
        return number, count

    def _by_shard(self, level: int, key: np.ndarray, own: np.ndarray):
        """Shards of the level and which of ``own`` belong to each, by their key."""
        shards = self.model.shards[level - 1]
        # Of few bytes, which are sorted faster.
        shard = _shard_of(key[own], shards).astype(np.min_scalar_type(shards))
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.model.shards[level - 1] + 1))
        for s in np.flatnonzero(np.diff(bounds)):
            yield int(s), own[order[bounds[s]:bounds[s + 1]]]

    def _heavy_left(self, level: int, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each context is a heavy one, and its ``g``."""
        heavy, out = np.zeros(len(parent), bool), np.ones(len(parent))
        if self.model.heavy[level - 2]:
            for s, own in self._by_shard(level, parent.astype(np.uint64), np.arange(len(parent))):
                keys, arrays = self._open("left", level, s)
                at, found = keys.successor(parent[own])
                heavy[own[found]] = True
                out[own[found]] = _restored(arrays, "left", at[found])
        return heavy, out

    def child(self, level: int, parent: np.ndarray, word: np.ndarray):
        """N-gram number (or -1) and first term of each child, and ``g`` of its context.

        Pairs are distinct, those of a parent together; ``g`` is 1 without children. A word
        that is not known has the begin mark's number, which no child has.
        """
        number = np.full(len(parent), -1, np.int64)
        value = np.zeros(len(parent))
        shards = self.model.shards[level - 1]
        run, first = _runs(parent)
        heavy, left = (x[run] for x in self._heavy_left(level, parent[first]))
        # A heavy context's children lie in the second half of the shards.
        for offset, key, own in (
                (0, parent.astype(np.uint64), np.flatnonzero(~heavy)),
                (shards, _key(parent, word, self.model.words), np.flatnonzero(heavy))):
            for s, part in self._by_shard(level, key, own):
                shard = self._open("ngrams", level, s + offset)
                at, place = shard.find(parent[part], word[part])
                if not offset:
                    left[part] = shard.left(place)
                part, at = part[at >= 0], at[at >= 0]
                number[part] = at + self.model.bases[level - 2][s + offset]
                value[part] = _restored(shard.arrays, "terms", at)
        return number, value, left

    def word_counts(self, number: np.ndarray) -> np.ndarray:
        """Counts by word number; a begin mark gives 0."""
        out = np.zeros(len(number))
        firsts = np.array([*self.model.firsts, self.model.words])
        for s in range(self.model.shards[0]):
            own = np.flatnonzero((number >= firsts[s]) & (number < firsts[s + 1]))
            if len(own):
                out[own] = self._open("words", 1, s)[1]["counts"][number[own] - firsts[s]]
        return out

    def ngram_counts(self, level: int, number: np.ndarray) -> np.ndarray:
        """Counts by n-gram number, while the level above is built."""
        bases = np.array(self.model.bases[level - 2])
        out = np.zeros(len(number))
        shard = np.searchsorted(bases, number, "right") - 1
        for s in np.unique(shard):
            own = shard == s
            counts = self._open("counts", level, int(s))["counts"]
            out[own] = counts[number[own] - bases[s]]
        return out


def _key(parent: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    """One number for parent and word: both must be known."""
    return parent.astype(np.uint64) * np.uint64(words + 1) + word.astype(np.uint64)


def _cut_key(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The parents and words of which ``_key`` made one number."""
    parent = keys // np.uint64(words + 1)
    return parent.astype(np.int64), (keys - parent * np.uint64(words + 1)).astype(np.int64)


class _Tokens(NamedTuple):
    """Tokens of a block, an end after each text: word number, count, text."""

    word: np.ndarray
    count: np.ndarray
    text: np.ndarray


def _hashes(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every token, each text's end included."""
    data = W.LOWER[block.data]
    found = W.words(data, block.bounds)
    n = len(block.bounds) - 1
    word = W.span_hashes(data, found.starts, found.ends)
    text = np.concatenate([found.text, np.arange(n)])
    order = np.argsort(text, kind="stable")
    return np.concatenate([word, np.full(n, _END, np.uint64)])[order], text[order]


def _tokens(levels: Levels, block: W.Block) -> _Tokens:
    hashes, text = _hashes(block)
    distinct, back = np.unique(hashes, return_inverse=True)
    number, count = levels.words(distinct)
    return _Tokens(number[back], count[back], text)


def _contexts(levels: Levels, tokens: _Tokens, order: int, last: bool):
    """For levels 2, 3, ...: tokens with a known context, and their distinct pairs.

    The context of level k is the n-gram of the k - 1 tokens before; before the
    first there is one begin mark, a word number of its own. Yields the level, the
    tokens, the pairs of context and word in rising order as ``_key`` and the pair of
    each token; and what ``child`` knows of the pairs, which of level ``order`` is looked
    up only if that is not the ``last`` one. A pair is sorted and looked up once.
    """
    n, words = len(tokens.word), levels.model.words
    first = np.ones(n, bool)
    first[1:] = tokens.text[1:] != tokens.text[:-1]
    context = np.empty(n, np.int64)
    context[1:] = tokens.word[:-1]
    context[first] = words
    word = np.where(tokens.word < 0, words, tokens.word)
    for level in range(2, order + 1):
        at = np.flatnonzero(context >= 0)
        pairs, back = np.unique(_key(context[at], word[at], words), return_inverse=True)
        if level == order and last:
            yield level, at, pairs, back, None
            return
        parent, of = _cut_key(pairs, words)
        found = levels.child(level, parent, of)
        yield level, at, pairs, back, found
        if level == order:
            return
        # The n-gram of context and token is the context of the next token.
        grown = np.full(n, -1, np.int64)
        grown[at] = found[0][back]
        context = np.full(n, -1, np.int64)
        context[1:] = grown[:-1]
        context[first] = -1


# -- building -----------------------------------------------------------------

def _bytes_of(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, that width first."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return bytes([width]) + raw[:, :width].tobytes()


def _from_bytes(raw: bytes) -> np.ndarray:
    width = raw[0]
    cut = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    whole = np.zeros((len(cut), 8), np.uint8)
    whole[:, :width] = cut
    return whole.view("<u8").ravel()


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, count = key[order], count[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
    return (key[head], np.add.reduceat(count, head)) if len(key) else (key, count)


class _Pending:
    """Counts of a task, sent in packed rows (shard, keys, counts).

    ``shard_of`` gives the shards of rising keys.
    """

    def __init__(self, shards: int, shard_of):
        self._shards, self._shard_of = shards, shard_of
        self._keys: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []
        self._held = 0

    def add(self, distinct: np.ndarray, counts: np.ndarray):
        self._keys.append(distinct)
        self._counts.append(counts)
        self._held += len(distinct)
        if self._held > _HELD:
            yield self.sent()

    def sent(self) -> pa.RecordBatch:
        keys = np.concatenate([*self._keys, np.zeros(0, np.uint64)])
        counts = np.concatenate([*self._counts, np.zeros(0, np.int64)])
        keys, counts = _summed(keys, counts)
        self._keys, self._counts, self._held = [], [], 0
        shard = self._shard_of(keys).astype(np.min_scalar_type(self._shards))
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self._shards + 1))
        rows = []
        for s in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[s]:bounds[s + 1]]
            rows.append((int(s), _bytes_of(np.diff(keys[own], prepend=np.uint64(0))),
                         _bytes_of(counts[own])))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()),
             pa.array([r[1] for r in rows], pa.binary()),
             pa.array([r[2] for r in rows], pa.binary())], names=["shard", "keys", "counts"])


def _gathered(rows: DataFrame, shards: int, finish, schema: str) -> DataFrame:
    """Run ``finish(shard, keys, counts)`` on the summed counts of every shard."""
    def run(batches):
        shard, held, size = None, [], 0
        for batch in batches:
            for s, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if shard is not None:
                        yield from finish(shard, *_summed(*map(np.concatenate, zip(
                            *held, strict=True))))
                    shard, held, size = s, [], 0
                held.append((np.cumsum(_from_bytes(keys), dtype=np.uint64),
                             _from_bytes(counts).astype(np.int64)))
                size += len(held[-1][0])
                if size > 2 * SHARD_ROWS and len(held) > 1:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    size = 0
        if shard is not None:
            yield from finish(shard, *_summed(*map(np.concatenate, zip(*held, strict=True))))

    return settle(rows.repartition(shards, "shard").sortWithinPartitions("shard")
                  .mapInArrow(run, schema), "shards")


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _word_level(texts: DataFrame, path: str, size: int) -> tuple[int, list, int]:
    shards = 1 << max(0, (size // SHARD_ROWS).bit_length())

    def by_range(keys):
        return ((keys >> np.uint64(64 - (shards - 1).bit_length())).astype(np.int64)
                if shards > 1 else np.zeros(len(keys), np.int64))

    def count(batches):
        pending = _Pending(shards, by_range)
        for batch in batches:
            for block in W.blocks(batch.column(0), BLOCK_BYTES):
                yield from pending.add(*np.unique(_hashes(block)[0], return_counts=True))
        yield pending.sent()

    def finish(shard, keys, counts):
        bits = 64 - (shards - 1).bit_length() if shards > 1 else 64
        rest = keys & np.uint64((1 << bits) - 1)
        write_arrays(f"{path}/words-1-{shard}", {
            **encode(rest >> np.uint64(1), 1 << (bits - 1), "keys"),
            "bit": (keys & np.uint64(1)).astype(np.uint8),
            "counts": counts.astype(np.uint32 if counts.max() < 1 << 32 else np.int64)})
        yield _rows(["shard", "words", "tokens"], [shard], [len(keys)], [int(counts.sum())])

    made = _gathered(texts.mapInArrow(count, "shard int, keys binary, counts binary"), shards,
                     finish, "shard long, words long, tokens long").collect()
    words = np.zeros(shards, np.int64)
    for row in made:
        words[row["shard"]] = row["words"]
    missing = np.flatnonzero(words == 0)
    for s in missing:
        write_arrays(f"{path}/words-1-{s}", {
            **encode(np.zeros(0, np.uint64), 1 << 62, "keys"), "bit": np.zeros(0, np.uint8),
            "counts": np.zeros(0, np.uint32)})
    return shards, words.tolist(), sum(r["tokens"] for r in made)


def _ngram_level(texts: DataFrame, model: Model, level: int, last: bool) -> Model:
    """The model with one more level; the ``last`` one needs no counts."""
    shards = max(1, -(-model.tokens // SHARD_ROWS))
    path, words = model.path, model.words

    def totals(levels: Levels, parents: np.ndarray) -> np.ndarray:
        if level == 2:
            return np.where(parents == words, float(model.texts), levels.word_counts(parents))
        return levels.ngram_counts(level - 1, parents)

    def count(batches):
        levels = Levels(model)
        light = _Pending(2 * shards, lambda keys: _shard_of(keys // np.uint64(words + 1), shards))
        heavy = _Pending(2 * shards, lambda keys: _shard_of(keys, shards) + shards)
        for batch in batches:
            for block in W.blocks(batch.column(0), BLOCK_BYTES):
                tokens = _tokens(levels, block)
                for at_level, at, pairs, back, _ in _contexts(levels, tokens, level, True):
                    if at_level == level:
                        # All words are known here: these are the training texts.
                        # No n-gram is seen more often than a word in it.
                        often = np.zeros(len(pairs), bool)
                        often[back] = tokens.count[at] >= model.min_count
                        times = np.bincount(back, minlength=len(pairs))[often]
                        pairs = pairs[often]
                        parent, _ = _cut_key(pairs, words)
                        run, first = _runs(parent)
                        spread = (totals(levels, parent[first]) >= HEAVY)[run]
                        yield from light.add(pairs[~spread], times[~spread])
                        yield from heavy.add(pairs[spread], times[spread])
        yield light.sent()
        yield heavy.sent()

    names = ["shard", "ngrams", "parent", "taken"]

    def finish(shard, keys, counts):
        levels = Levels(model)
        often = counts >= model.min_count
        keys, counts = keys[often], counts[often]
        parent = (keys // np.uint64(words + 1)).astype(np.int64)
        word = keys % np.uint64(words + 1)
        distinct, first, place = np.unique(parent, return_index=True, return_inverse=True)
        term = (counts - DISCOUNT) / totals(levels, distinct)[place]
        taken = np.add.reduceat(term, first) if len(first) else np.zeros(0)
        spread = shard >= shards
        write_arrays(f"{path}/ngrams-{level}-{shard}", {
            **encode(distinct, int(distinct[-1]) + 1 if len(distinct) else 1, "parents"),
            **encode(np.append(first, len(keys)), len(keys) + 1, "pointers"),
            **encode(place.astype(np.uint64) * np.uint64(words + 1) + word,
                     max(1, len(distinct)) * (words + 1), "children"),
            **_quantised(term, "terms"),
            # Of a heavy context other shards hold children too.
            **_quantised(np.zeros(0) if spread else np.clip(1.0 - taken, 1e-9, 1.0), "left")})
        if not last:
            write_arrays(f"{path}/counts-{level}-{shard}", {"counts": _small(counts)})
        yield _rows(names, np.array([shard]), np.array([len(keys)]), np.array([-1]),
                    np.array([0.0]))
        if spread:
            yield _rows(names, np.full(len(distinct), shard), np.zeros(len(distinct), np.int64),
                        distinct, taken)

    made = _gathered(texts.mapInArrow(count, "shard int, keys binary, counts binary"), 2 * shards,
                     finish, "shard long, ngrams long, parent long, taken double")
    sizes = np.zeros(2 * shards, np.int64)
    # One row a shard.
    found = made.filter("parent < 0").collect()
    for row in found:
        sizes[row["shard"]] = row["ngrams"]
    empty = {**encode(np.zeros(0, np.uint64), 1, "parents"),
             **encode(np.zeros(1, np.uint64), 1, "pointers"),
             **encode(np.zeros(0, np.uint64), 1, "children"),
             **_quantised(np.zeros(0), "terms"), **_quantised(np.zeros(0), "left")}
    heavy = bool(sizes[shards:].any())
    for s in set(range(2 * shards if heavy else shards)) - {r["shard"] for r in found}:
        write_arrays(f"{path}/ngrams-{level}-{s}", empty)
    bases = tuple((np.cumsum(sizes) - sizes).tolist())
    model = model._replace(order=level, shards=(*model.shards, shards),
                           bases=(*model.bases, bases), heavy=(*model.heavy, heavy))
    if heavy:
        _heavy_contexts(made.filter("parent >= 0"), model, level, shards)
    return model


def _heavy_contexts(taken: DataFrame, model: Model, level: int, shards: int) -> None:
    """Write ``g`` of every heavy context, summed over the shards of its children."""
    path = model.path

    def write(batches):
        for batch in batches:
            parent = batch.column(0).to_numpy()
            shard = _shard_of(parent.astype(np.uint64), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *batch.columns],
                                             names=["shard", "parent", "taken"])

    def finish(batches):
        table = pa.Table.from_batches(list(batches), schema=pa.schema(
            [("shard", pa.int32()), ("parent", pa.int64()), ("taken", pa.float64())]))
        shard, parent = table["shard"].to_numpy(), table["parent"].to_numpy()
        taken_part = table["taken"].to_numpy()
        for s in np.unique(shard):
            own = shard == s
            write_arrays(f"{path}/left-{level}-{s}", {
                **encode(parent[own], int(parent[own][-1]) + 1, "keys"),
                **_quantised(np.clip(1.0 - taken_part[own], 1e-9, 1.0), "left")})
            yield _rows(["shard"], np.array([s], np.int32))

    summed = taken.groupBy("parent").agg(F.sum("taken").alias("taken"))
    dealt = summed.mapInArrow(write, "shard int, parent long, taken double")
    done = {r["shard"] for r in settle(
        dealt.repartition(shards, "shard").sortWithinPartitions("shard", "parent")
        .mapInArrow(finish, "shard int"), "left").collect()}
    for s in set(range(shards)) - done:
        write_arrays(f"{path}/left-{level}-{s}", {
            **encode(np.zeros(0, np.uint64), 1, "keys"), **_quantised(np.zeros(0), "left")})


def train(spark: SparkSession, docs: DataFrame, text: str = "text", order: int = ORDER,
          min_count: int = MIN_COUNT) -> Model:
    """A model of all rows of ``docs``, its levels in a new shared folder."""
    texts = docs.select(F.col(text).alias("_text"))
    path = run_dir(spark, "ngrams")
    n, size = texts.agg(F.count(F.lit(1)),
                        F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    # A word and its space take six bytes or so: an upper bound for the shards' sizes.
    shards, words, tokens = _word_level(texts, path, (size // 6 + n) // 4)
    firsts = tuple((np.cumsum(words) - np.array(words)).tolist())
    model = Model(path, 1, (shards,), firsts, (), (), sum(words), tokens, n, min_count)
    for level in range(2, order + 1):
        model = _ngram_level(texts, model, level, level == order)
    return model


# -- scoring ------------------------------------------------------------------

def _scores(levels: Levels, block: W.Block) -> list[np.ndarray]:
    model = levels.model
    n = len(block.bounds) - 1
    tokens = _tokens(levels, block)
    p = (tokens.count + ADDED) / (model.tokens + ADDED * (model.words + 1))
    base = np.bincount(tokens.text, weights=np.log10(p), minlength=n)
    for _, at, _, back, (_, term, left) in _contexts(levels, tokens, model.order, False):
        # Contexts without children leave the lower level's estimate as it is.
        grown = (left < 1.0)[back]
        at, back = at[grown], back[grown]
        p[at] = np.minimum(term[back] + left[back] * p[at], 1.0)  # a rounded sum may pass one
    score = np.bincount(tokens.text, weights=np.log10(p), minlength=n)
    return [np.bincount(tokens.text, minlength=n),
            np.bincount(tokens.text[tokens.count > 0], minlength=n), base, score]


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "lm") -> DataFrame:
    """``docs`` with token counts, unigram and model log10 probability of the text."""
    types = [np.int64, np.int64, np.float64, np.float64]
    opened: list[Levels] = []

    def compute(column: pa.Array) -> list:
        if not opened:
            opened.append(Levels(model))
        return W.joined([_scores(opened[0], b) for b in W.blocks(column, BLOCK_BYTES)], types)

    return W.add_struct(docs, text, name, _FIELDS, compute)
