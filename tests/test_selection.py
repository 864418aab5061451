"""Medians by selection, stratified splits, and the area under the ROC curve."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from wardflow.operators import features, models


def _expanded(rows, i):
    return sorted(r[i] for r in rows for _ in range(r[-1]) if r[i] is not None and r[i] == r[i])


@pytest.mark.parametrize("bins", [7, 1024])
def test_medians_equal_brute_force(spark, monkeypatch, bins):
    monkeypatch.setattr(features, "BINS", bins)
    rng = random.Random(bins)
    rows = [(rng.choice([None, float("nan"), rng.gauss(0, 1), 5.0]), rng.choice([1e-300, -1e300, 7e200, 0.0]),
             float(rng.randint(0, 3)), None, 10.0 ** rng.randint(-200, 200), rng.randint(1, 4))
            for _ in range(701)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, copies long")
    found = features.medians(df.repartition(5), ["a", "b", "c", "d", "e"], "copies")
    for i, c in enumerate("abce"):
        own = _expanded([(*r[:3], r[4], r[5]) for r in rows], i)
        assert found[c] == statistics.median(own)
    assert found["d"] is None
    unweighted = features.medians(df, ["a"])
    assert unweighted["a"] == statistics.median(r[0] for r in rows if r[0] is not None and r[0] == r[0])


def test_median_of_many_distinct_values(spark):
    df = spark.range(1_000_001).select((F.col("id") * 3.5).alias("x"))
    assert features.medians(df, ["x"]) == {"x": 500_000 * 3.5}
    df = spark.range(1_000_000).select(F.col("id").cast("double").alias("x"))
    assert features.medians(df, ["x"]) == {"x": 499_999.5}
    assert features.medians(df.limit(0), ["x"]) == {"x": None}
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("inf"),)], "x double")
    assert features.medians(df, ["x"])["x"] > 1e308


@pytest.mark.parametrize("percent", [0, 20, 50, 100])
def test_a_stratified_split_is_exact(spark, percent):
    rows = [(i, 1.0 if i % 7 == 0 else 0.0) for i in range(2003)] + [(i, None) for i in range(3000, 3011)]
    df = spark.createDataFrame(rows, "id long, label double").repartition(4)
    train, test = features.stratified_split(df, ["id"], "label", percent)
    assert not set(map(tuple, train.collect())) & set(map(tuple, test.collect()))
    assert train.count() + test.count() == len(rows)
    for label in (0.0, 1.0, None):
        n = sum(r[1] == label for r in rows)
        got = sum(r.label == label for r in test.collect())
        assert got == (2 * n * percent + 100) // 200
    again = features.stratified_split(df.repartition(2), ["id"], "label", percent)[1]
    assert sorted(map(str, again.collect())) == sorted(map(str, test.collect()))


def test_rows_with_the_same_keys_stay_together(spark):
    df = spark.createDataFrame([(i // 10, 1) for i in range(500)], "id long, label int")
    train, test = features.stratified_split(df, ["id"], "label")
    assert not {r.id for r in train.collect()} & {r.id for r in test.collect()}
    assert abs(test.count() - 100) < 10
    assert features.stratified_split(df.limit(0), ["id"], "label")[1].count() == 0


@pytest.mark.parametrize("slices", [1, 7, 1024])
def test_area_equals_all_pairs(spark, monkeypatch, slices):
    monkeypatch.setattr(models, "SLICES", slices)
    rng = random.Random(1)
    rows = [(float(rng.random() < 0.3), rng.choice([0.1, 0.5, rng.random()]), float(rng.randint(1, 3)))
            for _ in range(400)] + [(None, 0.5, 1.0), (1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "label double, score double, w double").repartition(3)
    known = [r for r in rows if None not in r]
    area = total = 0.0
    for label, score, w in known:
        for other, other_score, v in known:
            if label == 1 and other == 0:
                total += w * v
                area += w * v * (1 if score > other_score else 0.5 if score == other_score else 0)
    assert models.roc_auc(df, "score", "w") == pytest.approx(area / total, rel=1e-12)
    assert models.roc_auc(df.filter("label = 1"), "score", "w") is None
    assert models.roc_auc(df.limit(0), "score", "w") is None
    assert models.roc_auc(df.withColumn("score", F.lit(1.0)), "score", "w") == 0.5
