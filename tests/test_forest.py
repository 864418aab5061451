"""The forests keep every row's node between levels, and grow the same trees as without."""

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wardflow.operators import models as M


def test_forest_keeps_nodes_and_grows_the_same_trees(spark):
    rows = spark.range(2_000).select(
        *[(F.xxhash64("id", F.lit(i)) % 50).cast("double").alias(f"x{i}") for i in range(4)],
        F.when(F.col("id") % 9 == 0, 3).otherwise(1).alias("copies"))
    rows = rows.withColumn("label", F.when(F.col("x0") + F.col("x1") * F.col("x2") / 20 > 5, 1.0)
                           .otherwise(0.0))
    made = VectorAssembler(inputCols=["x0", "x1", "x2", "x3"], outputCol="features").transform(rows)
    for copies in (None, "copies"):
        forest = M._forest("label", 5, 6, copies)
        assert forest.getCacheNodeIds()
        walked = forest.copy({forest.cacheNodeIds: False})
        trees = [f.fit(made).toDebugString.partition("\n")[2] for f in (forest, walked)]
        assert trees[0] == trees[1]
        assert "If (feature" in trees[0]
