"""Ranked search by terms: accumulators of short lists inside skipping over long ones.

Documents are indexed once, in shards of about ``SHARD_BYTES`` of text: each shard
is a row with its documents' ids and lengths and the inverted lists of all its
terms. Numbers of documents and terms, and each asked term's document frequency, are
added up over all shards. Then every task searches its shards for a block of
items and keeps each item's first ``k``; these few rows are ranked over all tasks.

In a shard an item's short lists are worked off term at a time: their scores
are summed into accumulators, which then count as one list, sorted by document,
with the greatest sum as its bound. This list and the long ones are read document
at a time, in growing stretches of documents. Lists whose bounds together stay
below the kth score found so far bring no new candidates; they are only looked up
for candidates that can still reach that score, the greatest bound first. The kth
score is carried from shard to shard of a task. Equal scores are never skipped, so
ties fall to the smaller id.

Terms are compared by 64-bit hashes of their lower-cased bytes. Items are taken in
blocks of about ``QUERY_BYTES`` of text (or one longer item), so what a task holds
of them is bounded; blocks beyond the first cost another scan of the index.

Defined results: a null or text without terms takes no part, as document or as
item. A document without id counts in the statistics and ranks behind equal scores
with one. Repeated document rows are ranked each; an item repeated with its
text counts once, and different texts under one id are items of their own. Other
columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow.llm import words as W
from wardflow.llm.pieces import ranges
from wardflow.session import settle

FIRST = 20
SHARD_BYTES = 1 << 23
QUERY_BYTES = 1 << 23
# Lists of at most this share of a shard's documents are worked off term at a time.
SHORT_SHARE = 32
# Documents of the first stretch; each further one has four times as many.
STRETCH = 256
# Parts in which an item's rows are ranked before they meet.
RANK_PARTS = 64

_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of a block's texts, and the text it stands in."""
    data = W.LOWER[block.data]
    found = W.words(data, block.bounds, _SEPARATORS)
    return W.span_hashes(data, found.starts, found.ends), found.text


# -- index ------------------------------------------------------------------------

_INDEX = ("docs long, tokens long, ids array<long>, lengths binary, terms binary, "
          "starts binary, doc binary, tf binary")


def _shard(ids: pa.Array, term: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """A row of the index. Lists are sorted by document."""
    n = len(ids)
    known, code = np.unique(term, return_inverse=True)
    entry, tf = np.unique(code * n + doc, return_counts=True)
    starts = np.searchsorted(entry, np.arange(len(known) + 1) * n)
    lengths = np.bincount(doc, minlength=n)
    row = [[int((lengths > 0).sum())], [len(term)], [ids],
           *[[a.tobytes()] for a in (lengths.astype(np.int64), known, starts.astype(np.int64),
                                     (entry % max(n, 1)).astype(np.int32), tf.astype(np.int32))]]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
    names = [c.split()[0] for c in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in
                                       zip(row, kinds, strict=True)], names=names)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The inverted index of the documents, written to the shared folder."""
    taken = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text"))

    def run(batches):
        ids, parts, size, n = [], [], 0, 0
        for batch in batches:
            for block in W.blocks(batch.column(1), min(W.BLOCK_BYTES, shard_bytes)):
                own = len(block.bounds) - 1
                hashes, doc = terms(block)
                ids += batch.column(0).slice(block.row, own).to_pylist()
                parts.append((hashes, doc + n))
                n, size = n + own, size + len(block.data)
                if size >= shard_bytes or n >= 1 << 20:
                    yield _shard(ids, *map(np.concatenate, zip(*parts, strict=True)))
                    ids, parts, size, n = [], [], 0, 0
        if n:
            yield _shard(ids, *map(np.concatenate, zip(*parts, strict=True)))

    return settle(taken.mapInArrow(run, _INDEX), "lexical-index")


# -- items --------------------------------------------------------------------------

class Items(NamedTuple):
    """A block of items: ids, and by item its terms' numbers and repeats."""

    ids: list
    starts: np.ndarray
    term: np.ndarray
    repeats: np.ndarray
    hashes: np.ndarray


def _item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    rows = items.select(items[item_id].alias("id"), items[text].alias("text")).filter(
        F.col("text").isNotNull()).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for block in range(blocks):
        # About block_bytes of text, or one longer item.
        found = rows.filter(part == block).collect()
        ids, starts, numbers, repeats = [], [0], [], []
        for row in found:
            own = W.Block(0, *W.text_bytes(pa.array([row["text"]], pa.string())))
            hashes, times = np.unique(terms(own)[0], return_counts=True)
            if len(hashes):
                ids.append(row["id"])
                starts.append(starts[-1] + len(hashes))
                numbers.append(hashes)
                repeats.append(times)
        if ids:
            hashes, term = np.unique(np.concatenate(numbers), return_inverse=True)
            yield Items(ids, np.array(starts), term, np.concatenate(repeats), hashes)


def _frequencies(indexed: DataFrame, items: Items) -> np.ndarray:
    """Number of documents that hold each term of a block of items."""
    asked = items.hashes

    def run(batches):
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for known, starts in zip(batch.column(0), batch.column(1), strict=True):
                known = np.frombuffer(known.as_buffer(), np.uint64)
                starts = np.frombuffer(starts.as_buffer(), np.int64)
                at = np.searchsorted(known, asked)
                hit = np.flatnonzero(at < len(known))
                hit = hit[known[at[hit]] == asked[hit]]
                total[hit] += starts[at[hit] + 1] - starts[at[hit]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])],
                                         names=["term", "docs"])

    found = (indexed.select("terms", "starts").mapInArrow(run, "term long, docs long")
             .groupBy("term").agg(F.sum("docs").alias("docs")).toPandas())
    out = np.zeros(len(asked), np.int64)
    out[found["term"].to_numpy(np.int64)] = found["docs"].to_numpy(np.int64)
    return out


# -- search -------------------------------------------------------------------------

class First:
    """The first ``k`` of an item: scores, then ids; ids that are null come last."""

    def __init__(self, k: int):
        self._k = k
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    @property
    def least(self) -> int:
        """The score that a further document must reach."""
        return int(self.score[-1]) if len(self.score) == self._k else 1

    def add(self, score: np.ndarray, id_: np.ndarray, null: np.ndarray) -> None:
        score, id_, null = (np.concatenate(x) for x in (
            (self.score, score), (self.id, id_), (self.null, null)))
        first = np.lexsort((id_, null, -score))[:self._k]
        self.score, self.id, self.null = score[first], id_[first], null[first]


class _List(NamedTuple):
    """Documents, rising, with their scores, and the greatest score."""

    doc: np.ndarray
    score: np.ndarray
    bound: int


def _summed(lists: list[_List]) -> _List:
    """Accumulators of short lists, term at a time, as one list."""
    doc, which = np.unique(np.concatenate([x.doc for x in lists]), return_inverse=True)
    score, at = np.zeros(len(doc), np.int64), 0
    for one in lists:
        score[which[at:at + len(one.doc)]] += one.score
        at += len(one.doc)
    return _List(doc, score, int(score.max(initial=0)))


def search_lists(lists: list[_List], n: int, ids: np.ndarray, null: np.ndarray,
                 first: First, short: int | None = None) -> int:
    """Add a shard's documents to an item's first ones; returns list entries read."""
    short = max(1, n // SHORT_SHARE) if short is None else short
    few = [x for x in lists if len(x.doc) <= short]
    lists = [x for x in lists if len(x.doc) > short] + ([_summed(few)] if few else [])
    lists.sort(key=lambda x: x.bound)
    reach = np.cumsum([x.bound for x in lists])  # what this list and those before can add
    read = sum(len(x.doc) for x in few)
    at = [0] * len(lists)
    low, width = 0, STRETCH
    while low < n:
        high = min(n, low + width)
        # Lists before this one cannot together reach the kth score.
        essential = int(np.searchsorted(reach, first.least))
        if essential == len(lists):
            break
        total = np.zeros(high - low, np.int64)
        for i in range(essential, len(lists)):
            one = lists[i]
            start = at[i] if at[i] >= 0 else int(np.searchsorted(one.doc, low))
            stop = int(np.searchsorted(one.doc, high))
            total[one.doc[start:stop] - low] += one.score[start:stop]
            at[i] = stop
            read += stop - start
        candidate = np.flatnonzero(total)
        score = total[candidate]
        for i in range(essential - 1, -1, -1):
            keep = score + reach[i] >= first.least
            candidate, score = candidate[keep], score[keep]
            at[i] = -1  # skipped: found again if it becomes essential
            if not len(candidate):
                break
            one = lists[i]
            place = np.searchsorted(one.doc, candidate + low)
            hit = np.flatnonzero(place < len(one.doc))
            hit = hit[one.doc[place[hit]] == candidate[hit] + low]
            score[hit] += one.score[place[hit]]
            read += len(candidate)
        keep = score >= first.least
        if keep.any():
            doc = candidate[keep] + low
            first.add(score[keep], ids[doc], null[doc])
        low, width = high, width * 4
    return read


def _searched(indexed: DataFrame, items: Items, weight: np.ndarray, docs: int, tokens: int,
              k: int) -> DataFrame:
    def run(batches):
        best = [First(k) for _ in items.ids]
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].values
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                lengths, known, starts, doc, tf = (
                    np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in
                    enumerate((np.int64, np.uint64, np.int64, np.int32, np.int32), 1))
                at = np.searchsorted(known, items.hashes)
                held = np.flatnonzero(at < len(known))
                held = held[(known[at[held]] == items.hashes[held]) & (weight[held] > 0)]
                if not len(held):
                    continue
                size = starts[at[held] + 1] - starts[at[held]]
                # Each list's part of the score, once for all items of the block.
                entry = ranges(starts[at[held]], size)
                m = 75 + (25 * lengths * docs) // tokens
                own = doc[entry].astype(np.int64)
                times = tf[entry].astype(np.int64)
                part = 1_000_000_000 * times // (1000 * times + 12 * m[own])
                part *= np.repeat(weight[held], size)
                ends = np.cumsum(size)
                most = np.maximum.reduceat(part, ends - size)
                place = np.full(len(items.hashes), -1)
                place[held] = np.arange(len(held))
                for item, first in enumerate(best):
                    span = slice(items.starts[item], items.starts[item + 1])
                    lists = []
                    for t, r in zip(place[items.term[span]].tolist(),
                                    items.repeats[span].tolist(), strict=True):
                        if t >= 0:
                            a, b = ends[t] - size[t], ends[t]
                            lists.append(_List(own[a:b], part[a:b] * r if r > 1 else part[a:b],
                                               int(most[t]) * r))
                    if lists:
                        search_lists(lists, len(ids), ids, null, first)
        salt = TaskContext.get().partitionId() % RANK_PARTS
        for item, first in enumerate(best):
            found = len(first.score)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(found, item)), pa.array(np.full(found, salt, np.int32)),
                     pa.array(first.id, mask=first.null), pa.array(first.score)],
                    names=["item", "part", "doc_id", "score"])

    return (indexed.select("ids", "lengths", "terms", "starts", "doc", "tf")
            .mapInArrow(run, "item long, part int, doc_id long, score long"))


def search(indexed: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text",
           k: int = FIRST, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's best documents."""
    spark = indexed.sparkSession
    id_type = items.schema[item_id].dataType
    out = f"item_id {id_type.simpleString()}, rank int, doc_id long, score long"
    found = indexed.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
    docs, tokens = found["docs"] or 0, found["tokens"] or 0
    best = None
    for block in _item_blocks(items, item_id, text, block_bytes) if tokens else ():
        weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(df) + 1)))
                           for df in _frequencies(indexed, block)], np.int64)
        rows = _searched(indexed, block, weight, docs, tokens, k)
        by = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        for keys in (["item", "part"], ["item"]):
            rows = rows.withColumn("rank", F.row_number().over(
                Window.partitionBy(*keys).orderBy(*by))).filter(F.col("rank") <= k)
        # One row an item of the block.
        names = spark.createDataFrame(list(enumerate(block.ids)),
                                      f"item long, item_id {id_type.simpleString()}")
        rows = rows.join(names, "item").select("item_id", "rank", "doc_id", "score")
        best = rows if best is None else best.unionByName(rows)
    return best if best is not None else spark.createDataFrame([], out)
