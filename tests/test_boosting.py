"""The boosted trees are those of Spark's learner, made in passes over blocks."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from wardflow.operators import boosting as B

NAMES = [f"x{i}" for i in range(4)]


def _rows(spark, n):
    """Whole numbers, a half, one value for all, few values; a label with some noise."""
    rows = spark.range(n, numPartitions=3).select(
        "id", *[((F.xxhash64("id", F.lit(i)) % m) / 2).alias(f"x{i}")
                for i, m in enumerate((200, 61, 1, 4))])
    noise = (F.xxhash64("id", F.lit(9)) % 7).cast("double")
    return rows.withColumn("label", F.when(F.col("x0") > 20, 10.0).otherwise(F.col("x1"))
                           + F.col("x3") * F.col("x0") / 9 + noise)


def _fit(rows, rounds):
    return B.fit(rows.withColumn("numbers", F.array(*NAMES)), "numbers", "label", ["id"], rounds,
                 3, 0.1, 42)


def test_trees_are_those_of_sparks_learner(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 300)
    rows = _rows(spark, 4_000)
    trees = _fit(rows, 12)
    assert len(trees.trees) == 12
    made = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    model = GBTRegressor(maxIter=12, maxDepth=3, stepSize=0.1, seed=42).fit(made)
    both = model.transform(made).select("prediction", F.expr(trees.sql(NAMES)).alias("own"))
    assert both.selectExpr("max(abs(prediction - own))").first()[0] < 1e-9


def test_rests_do_not_depend_on_where_they_begin_anew(spark, monkeypatch):
    rows = _rows(spark, 500)
    found = []
    for fresh in (1, 3, 100):
        monkeypatch.setattr(B, "FRESH", fresh)
        found.append(np.array([tree.value for tree in _fit(rows, 7).trees]))
    assert found[0] == pytest.approx(found[1]) and found[0] == pytest.approx(found[2])


def test_labels_that_do_not_vary_make_one_leaf(spark):
    trees = _fit(_rows(spark, 200).withColumn("label", F.lit(7.0)), 3)
    assert all((tree.feature == -1).all() for tree in trees.trees)
    assert spark.range(1).selectExpr(trees.sql(NAMES)).first()[0] == 7.0


def test_limits_of_more_rows_come_from_a_sample_by_key(spark, monkeypatch):
    monkeypatch.setattr(B, "SAMPLED", 400)
    rows = _rows(spark, 4_000)
    a, b = (_fit(x, 1) for x in (rows, rows.repartition(5)))
    assert [t.tolist() for t in a.thresholds] == [t.tolist() for t in b.thresholds]
    assert [len(t) for t in a.thresholds] == [31, 31, 0, 6]
    # Keys that repeat draw the same number: none of the rows, or all of them.
    for key in range(8):
        assert len(_fit(rows.withColumn("id", F.lit(key)), 1).trees) == 1


def test_what_a_pass_returns_does_not_grow_with_the_rows(spark):
    """One bounded row a task, and fifteen bytes a row in the blocks for seven numbers."""
    rows = _rows(spark, 3_000).select(F.array(*NAMES).alias("numbers"), "label")
    limits = [np.arange(5.0)] * 4
    blocks = B._blocks(rows, limits, 3_000)
    size = blocks.selectExpr("sum(octet_length(bins) + octet_length(rest))").first()[0]
    assert size == 3_000 * (4 + 8)
    leaf = B.Tree(np.full(15, -1), np.zeros(15, int), np.zeros(15))
    sums, squares = B._sums(blocks, leaf, 0, 4)
    assert sums.shape == (1, 4, B.BINS, 2) and squares.shape == (1,)
    assert sums[0, :, :, 0].sum(axis=1).tolist() == [3_000.0] * 4
