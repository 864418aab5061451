"""Quality by a sparse ensemble of rules over statistics of the text.

Small trees are grown on labelled rows. Every path from a root to an inner node
or leaf is a rule, a conjunction of limits on statistics. A logistic model with
a lasso penalty weighs the rules, most of them by zero. The rest are compiled
into one Spark column expression over the statistics.

The trees and weights are fitted on at most ``train_rows`` labelled rows, those
with the smallest hash of the id. Everything else covers all rows.

Defined results: a null text counts as empty and gets a score too. Without
labelled rows of both classes there are no rules, and the score is the share of
label 1 (0.5 without labels). Ids may be null or repeated: the statistics travel
with their row, so none is lost or doubled by a join. Columns pass whatever their
names; an empty table gives an empty one. Texts of any length are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from wardflow.llm import words as W
from wardflow.llm.carried import Carried
from wardflow.session import settle

TRAIN_ROWS = 20_000
TREES = 24
DEPTH = 3
PENALTY = 0.002
# A bound that the lasso fit is not meant to reach: it ends by its tolerance.
STEPS = 1000
# Tasks of a step: at most ``TRAIN_ROWS`` rows, equal ones merged.
FIT_TASKS = 4

STATISTICS = [
    "log_words", "word_length", "log_lines", "words_per_line", "upper", "digit", "symbol",
    "exclaim", "pipe", "stop", "comma", "other_punctuation", "not_ascii", "blank",
    "distinct_words", "repeated_windows", "repeated_lines", "upper_words", "symbol_words",
    "top_word", "adjacent_equal",
]
FIELDS = StructType()
for _name in STATISTICS:
    FIELDS = FIELDS.add(_name, DoubleType())


def _kind(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER = _kind(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _kind(b"abcdefghijklmnopqrstuvwxyz")
_DIGIT = _kind(b"0123456789")
_SYMBOL = _kind(b"#*$%&<>@^~`_+=\\{}[]/")
_OTHER = _kind(b";:'\"-()?")


def _measure(block: W.Block) -> list[np.ndarray]:
    data, bounds = block.data, block.bounds
    n = len(bounds) - 1
    found = W.words(data, bounds)
    word = W.span_hashes(data, found.starts, found.ends)
    count = np.bincount(found.text, minlength=n)
    size = np.maximum(np.diff(bounds), 1)
    n_words = np.maximum(count, 1)

    def share(table: np.ndarray) -> np.ndarray:
        return W.per_text(table[data], bounds) / size

    lines = W.per_text(data == 0x0A, bounds) + 1
    text = found.text.astype(np.uint64)
    own = W.mix(word + text)
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    head = np.ones(len(own), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, len(own)))
    run_text = found.text[order[at]]
    distinct = np.bincount(run_text, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, run_text, runs)

    window, first = W.window_hashes(word, found.text, 3)
    twice, _ = W.repeated(W.mix(window + text[first]))
    windows = np.bincount(found.text[first[twice]], minlength=n)
    adjacent = np.zeros(len(word), bool)
    adjacent[1:] = (word[1:] == word[:-1]) & (found.text[1:] == found.text[:-1])

    starts = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 0x0A) + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    line = W.span_hashes(data, starts, ends)
    line_text = np.searchsorted(bounds, starts, "right") - 1
    _, earlier = W.repeated(W.mix(line + line_text.astype(np.uint64)))
    repeats = np.bincount(line_text[earlier], minlength=n)

    def of_words(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        return total[found.ends] - total[found.starts]

    letters = of_words(_LETTER)
    shouted = (letters > 0) & (of_words(_UPPER) == letters)
    marked = of_words(_SYMBOL) > 0
    bare = _kind(b" \t\n\x0b\x0c\r")
    return [
        np.log1p(count), W.per_text(~bare[data], bounds) / n_words, np.log1p(lines),
        count / lines, share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_kind(b"!")),
        share(_kind(b"|")), share(_kind(b".")), share(_kind(b",")), share(_OTHER),
        W.per_text(data >= 0x80, bounds) / size, share(bare), distinct / n_words,
        windows / n_words, repeats / lines,
        np.bincount(found.text[shouted], minlength=n) / n_words,
        np.bincount(found.text[marked], minlength=n) / n_words,
        top / n_words, np.bincount(found.text[adjacent], minlength=n) / n_words,
    ]


def with_statistics(docs: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """``docs`` with a struct of statistics of the whole text."""
    types = [np.float64] * len(STATISTICS)

    def compute(column: pa.Array) -> list:
        return W.joined([_measure(b) for b in W.blocks(column)], types)

    return W.add_struct(docs, text, name, FIELDS, compute)


@dataclass(frozen=True)
class Limit:
    """One side of a split: a statistic up to a threshold, or beyond it."""

    statistic: str
    threshold: float
    beyond: bool

    def column(self, struct: str) -> Column:
        value = F.col(f"{struct}.{self.statistic}")
        return value > self.threshold if self.beyond else value <= self.threshold


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted conjunctions of limits; without rules the score is constant."""

    intercept: float
    rules: tuple[tuple[frozenset[Limit], float], ...]

    def score(self, struct: str = "statistics") -> Column:
        total = F.lit(self.intercept)
        for limits, weight in self.rules:
            total = total + F.when(_conjunction(limits, struct), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _conjunction(limits: frozenset[Limit], struct: str) -> Column:
    ordered = sorted(limits, key=lambda x: (x.statistic, x.threshold, x.beyond))
    return reduce(and_, [x.column(struct) for x in ordered])


def _paths(node, above: frozenset[Limit], found: dict) -> None:
    """Collect the path to every node below ``node``, a tree node of Spark."""
    if above:
        found[above] = None
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    name, threshold = STATISTICS[split.featureIndex()], float(split.threshold())
    for child, beyond in ((node.leftChild(), False), (node.rightChild(), True)):
        _paths(child, above | {Limit(name, threshold, beyond)}, found)


def fit(labelled: DataFrame, label: str, struct: str = "statistics", trees: int = TREES,
        depth: int = DEPTH, penalty: float = PENALTY, steps: int = STEPS,
        seed: int = 7) -> RuleEnsemble:
    """Fit on rows with a 0/1 label and a struct of statistics."""
    rows = settle(labelled.select(F.col(label).cast("double").alias("label"), struct)
                  .filter("label IN (0, 1)"), "quality-rows")
    ones, n = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not n or ones in (0, n):
        share = ones / n if n else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    features = rows.select("label", struct, array_to_vector(F.array(
        *[F.col(f"{struct}.{s}") for s in STATISTICS])).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64,
                                    featureSubsetStrategy="onethird",
                                    subsamplingRate=0.7).fit(features)
    found: dict[frozenset[Limit], None] = {}
    for tree in forest.trees:
        _paths(tree._java_obj.rootNode(), frozenset(), found)
    if not found:
        return RuleEnsemble(float(np.log(ones / (n - ones))), ())
    rules = list(found)
    # Rows on which the same rules fire are one row with a weight, in few partitions:
    # a step is then a job of little work.
    fired = settle(features.select("label", F.array(
        *[F.coalesce(_conjunction(r, struct), F.lit(False)) for r in rules]).alias("fired"))
        .groupBy("label", "fired").agg(F.count(F.lit(1)).cast("double").alias("copies"))
        .coalesce(FIT_TASKS), "fired-rules")
    fired = fired.select("label", "copies", array_to_vector(F.transform(
        "fired", lambda x: x.cast("double"))).alias("features"))
    # Spark's deviations of weighted rows are all too large by one factor, which would
    # raise the penalty; without it the objective is that of the single rows.
    total, squares = fired.agg(F.sum("copies"), F.sum(F.col("copies") * F.col("copies"))).first()
    factor = np.sqrt((total - 1) / (total - squares / total))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty / float(factor), maxIter=steps,
                               weightCol="copies", standardization=True).fit(fired)
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(float(lasso.intercept), tuple(
        (r, float(w)) for r, w in zip(rules, weights, strict=True) if w != 0.0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str,
                  train_rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``train_rows`` labelled documents, outside the held-out fifth.

    The ids with the smallest hash are taken. They are few, so they are
    broadcast to the documents, whose texts stay where they are.
    """
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()
                           & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max(label).alias("_label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def held_out(doc_id: Column) -> Column:
    """Whether the id belongs to the fifth that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """Rules for ``labels.quality``."""
    return fit(with_statistics(training_rows(docs, labels, "quality", train_rows)), "_label")


def scored(docs: DataFrame, model: RuleEnsemble, name: str = "score",
           text: str = "text") -> DataFrame:
    """``docs`` with the score of the whole text; a column of that name is replaced."""
    carried = Carried(docs)
    measured = with_statistics(carried.rows, carried[text], "_statistics")
    return measured.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried.names)
                             if c != name], model.score("_statistics").alias(name))


def kept_documents(docs: DataFrame, model: RuleEnsemble, least: float) -> DataFrame:
    """The documents with a score of at least ``least``, in the same columns."""
    carried = Carried(docs)
    measured = with_statistics(carried.rows, carried["text"], "_statistics")
    return carried.back(measured.filter(model.score("_statistics") >= least))
