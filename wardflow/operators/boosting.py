"""Boosted regression trees, learnt by Spark from blocks of binned rows.

Every feature is cut into at most ``BINS`` bins. A block holds the bins of some rows,
one byte each, and what the trees so far leave of their labels. A level of a tree is
one job: each task adds up the rows and rests of its blocks by node, feature and bin,
and the driver chooses each node's split from the sums, which are as small whatever
the rows. A round thus passes over fifteen bytes a row three times.

The trees are those of Spark's learner: splits of least variance between bins of about
equal numbers of rows, the first tree on the labels, each later one on twice the rest,
taken by the rate. Bins are cut by all rows up to ``SAMPLED``, else by a sample of
about as many, as there; here it is drawn by a hash of the keys, so it does not
depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.operators.features import draw
from wardflow.session import settle

BINS = 32
SAMPLED = 10_000
BLOCK_ROWS = 1 << 15
# Rows of a task, if the session has too few cores for fewer.
TASK_ROWS = 1 << 21
# Rounds after which the rests are made from the labels again, so that what a lost
# executor held is not made through all rounds.
FRESH = 10
# A node whose labels vary less is a leaf.
EPSILON = 2.0 ** -52

_BLOCKS = "bins binary, rest binary"


class Tree(NamedTuple):
    """A tree in heap order: node i has the children 2i + 1 and 2i + 2.

    ``feature`` is -1 at leaves; a row goes left if its bin is ``cut`` or less.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


class Trees(NamedTuple):
    """The sum of the trees' values is the prediction; ``thresholds`` by feature."""

    trees: list[Tree]
    thresholds: list[np.ndarray]

    def sql(self, features: Sequence[str]) -> str:
        """The prediction as SQL text over the columns of the features."""
        def node(tree: Tree, i: int) -> str:
            f = tree.feature[i]
            if f < 0:
                return f"{float(tree.value[i])!r}D"
            limit = float(self.thresholds[f][tree.cut[i]])
            return (f"IF({features[f]} <= {limit!r}D, {node(tree, 2 * i + 1)}, "
                    f"{node(tree, 2 * i + 2)})")

        # As one sum, a hundred trees are compiled to a method too long for the JVM to speed up.
        votes = ", ".join(node(tree, 0) for tree in self.trees)
        return f"aggregate(array({votes}), 0D, (sum, vote) -> sum + vote)"


# -- bins ---------------------------------------------------------------------

def thresholds(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Limits between bins of about equal numbers of values, midway between two of them."""
    found, times = np.unique(values, return_counts=True)
    middle = (found[:-1] + found[1:]) / 2
    limits = min(bins, len(values)) - 1
    if len(middle) <= limits:
        return middle
    out, upto = [], np.cumsum(times)
    target = stride = len(values) / (limits + 1)
    for i in range(len(middle)):
        # The limit lies where the number of values below is nearest to the wanted one.
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            out.append(middle[i])
            target += stride
    return np.array(out)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(rows: DataFrame, limits: list[np.ndarray], n: int) -> DataFrame:
    """The rows as blocks of bins, feature by feature, and labels."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels = [], []

        def sent() -> pa.RecordBatch:
            values, rest = np.concatenate(held), np.concatenate(labels)
            binned = np.stack([np.searchsorted(at, values[:, f], "left").astype(np.uint8)
                               for f, at in enumerate(limits)])
            held.clear()
            labels.clear()
            return _block(binned, rest)

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                held.append(_matrix(part.column(0), len(limits)))
                labels.append(part.column(1).to_numpy())
                if sum(map(len, labels)) >= BLOCK_ROWS:
                    yield sent()
        if held:
            yield sent()

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, n // BLOCK_ROWS + 1), n // TASK_ROWS + 1)
    return settle(rows.mapInArrow(pack, _BLOCKS).repartition(parts), "blocks")


def _block(binned: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([binned.tobytes()], pa.binary()), pa.array([rest.tobytes()], pa.binary())],
        names=["bins", "rest"])


def _opened(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for bins, rest in zip(*batch.columns, strict=True):
        yield (np.frombuffer(bins.as_buffer(), np.uint8).reshape(width, -1),
               np.frombuffer(rest.as_buffer(), np.float64))


# -- passes -------------------------------------------------------------------

def _nodes(tree: Tree, binned: np.ndarray, depth: int) -> np.ndarray:
    """The node in which each row stands after ``depth`` levels at most."""
    at = np.zeros(binned.shape[1], np.int8)
    for level in range(depth):
        for i in range((1 << level) - 1, (2 << level) - 1):
            if tree.feature[i] >= 0:
                right = binned[tree.feature[i]] > tree.cut[i]
                if level:
                    here = at == i
                    at[here] = 2 * i + 1 + right[here]
                else:
                    at = (1 + right).astype(np.int8)
    return at


def _rests(blocks: DataFrame, trees: list[Tree], width: int, depth: int) -> DataFrame:
    """The blocks with the values of some more trees taken off."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for binned, rest in _opened(batch, width):
                for tree in trees:
                    rest = rest - tree.value[_nodes(tree, binned, depth)]
                yield _block(binned, rest)

    return blocks.mapInArrow(run, _BLOCKS)


def _sums(blocks: DataFrame, tree: Tree, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and rests by node of the level, feature and bin; squared rests by node."""
    first, nodes = (1 << level) - 1, 1 << level
    shape = (nodes, width, BINS, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(shape), np.zeros(nodes)
        for batch in batches:
            for binned, rest in _opened(batch, width):
                at = _nodes(tree, binned, level) - np.int8(first)
                own = at >= 0  # the others stand in leaves above
                if not own.all():
                    at, binned, rest = at[own], binned[:, own], rest[own]
                squares += np.bincount(at, rest * rest, nodes)
                base = at.astype(np.int64) * BINS
                for f in range(width):
                    key = base + binned[f]
                    total[:, f, :, 0] += np.bincount(key, minlength=nodes * BINS).reshape(nodes, -1)
                    total[:, f, :, 1] += np.bincount(key, rest, nodes * BINS).reshape(nodes, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([total.tobytes()], pa.binary()), pa.array([squares.tobytes()], pa.binary())],
            names=["sums", "squares"])

    # One row a task, of a size that does not depend on the rows.
    made = blocks.mapInArrow(run, "sums binary, squares binary").collect()
    return (sum(np.frombuffer(r["sums"]).reshape(shape) for r in made),
            sum(np.frombuffer(r["squares"]) for r in made))


def _grown(blocks: DataFrame, width: int, depth: int, times: float) -> Tree:
    """A tree on the rests of the blocks; its values are the means ``times`` so much."""
    size = (2 << depth) - 1
    tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
    open_ = {0}
    for level in range(depth):
        if not open_:
            break
        first = (1 << level) - 1
        sums, squares = _sums(blocks, tree, level, width)
        for i in sorted(open_):
            open_.remove(i)
            n, s = sums[i - first, 0].sum(axis=0)
            if not level:
                tree.value[i] = times * s / n
            if squares[i - first] / n - (s / n) ** 2 < EPSILON:
                continue
            left = np.cumsum(sums[i - first], axis=1)[:, :-1]
            n_left, s_left = left[..., 0], left[..., 1]
            n_right, s_right = n - n_left, s - s_left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s_left ** 2 / n_left + s_right ** 2 / n_right - s * s / n
            gain[(n_left == 0) | (n_right == 0)] = -1.0
            f, cut = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[f, cut] <= 0:
                continue
            tree.feature[i], tree.cut[i] = f, cut
            for child, of, rows in ((2 * i + 1, s_left, n_left), (2 * i + 2, s_right, n_right)):
                tree.value[child] = times * of[f, cut] / rows[f, cut]
                open_.add(child)
        open_ = {i for i in open_ if i >= (2 << level) - 1}
    return tree


def fit(rows: DataFrame, features: str, label: str, keys: Sequence[str], rounds: int, depth: int,
        rate: float, seed: int) -> Trees:
    """Trees for rows with an array of numbers and a label; ``keys`` draw the sample."""
    n = rows.count()
    sample = rows if n <= SAMPLED else rows.filter(
        draw(keys, seed + 1) < F.lit(int(2.0 ** 48 * SAMPLED / n)))
    # Keys that repeat draw the same number, so the sample is bounded.
    values = np.array([r[0] for r in sample.select(features).limit(2 * SAMPLED).collect()], float)
    if not len(values):
        values = np.array([r[0] for r in rows.select(features).limit(SAMPLED).collect()], float)
    limits = [thresholds(values[:, f]) for f in range(values.shape[1])]
    width = len(limits)
    blocks = _blocks(rows.select(features, F.col(label).cast("double")), limits, n)
    trees: list[Tree] = []
    kept, taken = None, 0
    for turn in range(rounds):
        source, since = (blocks, 0) if kept is None or turn % FRESH == 0 else (kept, taken)
        rests = _rests(source, trees[since:], width, depth).persist(StorageLevel.MEMORY_AND_DISK)
        before, kept, taken = kept, rests, len(trees)
        trees.append(_grown(rests, width, depth, 2 * rate if trees else 1.0))
        if before is not None:
            before.unpersist()
    if kept is not None:
        kept.unpersist()
    return Trees(trees, limits)
