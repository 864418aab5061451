"""Places and previous rows per key, by one plan for keys of any size.

A segmented scan. Rows are dealt by range of key and order, so the rows of a key
lie in one part or in several that follow each other. Each part is numbered by
itself. What a key has in earlier parts (its number of rows, its last row) is
then carried over. Only a key that reaches over the border of two parts has
something to carry, so the carried table has at most one row per part. Parts have
about equal numbers of rows whatever the keys, also where all rows of a key have
the same time or none.

The dealt rows are written to the shared folder: both passes must see the same
borders, which come from a sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wardflow.session import settle

_PART = "_part"


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
           parts: int | None) -> DataFrame:
    by = [*keys, *order]
    rows = df.repartitionByRange(*by) if parts is None else df.repartitionByRange(parts, *by)
    return settle(rows.withColumn(_PART, F.spark_partition_id()), "dealt")


def _cut_keys(rows: DataFrame, keys: Sequence[str]) -> list[tuple]:
    """Keys that lie in two parts or more: at most one per border.

    Such a key is the last of one part and the first of another, so two keys a part
    tell them all.
    """
    key = F.struct(*keys)
    ends = rows.groupBy(_PART).agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()
    parts = Counter(end for row in ends for end in {tuple(row["first"]), tuple(row["last"])})
    return [end for end, n in parts.items() if n > 1]


def _of_keys(rows: DataFrame, keys: Sequence[str], cut: list[tuple]) -> DataFrame:
    """The rows of the cut keys, which are no more than the parts."""
    schema = StructType([StructField(f"_cut{i}", rows.schema[k].dataType)
                         for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_cut{i}")) for i, k in enumerate(keys)]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(cut, schema)), same, "left_semi")


def _with_carried(rows: DataFrame, keys: Sequence[str], carried: DataFrame) -> DataFrame:
    """``rows`` with the columns carried into their key's part, NULL for none."""
    names = [*keys, _PART]
    few = carried.withColumnsRenamed({k: f"_of_{k}" for k in names})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in names]
    return rows.join(F.broadcast(few), same, "left").drop(*[f"_of_{k}" for k in names])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str,
             parts: int | None = None) -> DataFrame:
    """The rows of each key numbered from 1 in the given order, which must be unique."""
    rows = _dealt(df, keys, order, parts)
    local = Window.partitionBy(*keys, _PART).orderBy(*order)
    placed = rows.withColumn(name, F.row_number().over(local).cast("bigint"))
    cut = _cut_keys(rows, keys)
    if not cut:
        return placed.select(*df.columns, name)
    by_part = Window.partitionBy(*keys).orderBy(_PART)
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    # One row per cut key and part.
    sizes = _of_keys(rows, keys, cut).groupBy(*keys, _PART).agg(F.count(F.lit(1)).alias("_rows"))
    before = (sizes.withColumn("_before", F.sum("_rows").over(earlier))
              .filter("_before IS NOT NULL").drop("_rows"))
    return (_with_carried(placed, keys, before)
            .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
            .select(*df.columns, name))


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], lags: dict[str, str],
           parts: int | None = None) -> DataFrame:
    """``df`` with values of the previous row of the same key.

    The rows of a key ascend by the columns ``order``, which must be unique. ``lags``
    maps each new column to the column it is taken from.
    """
    rows = _dealt(df, keys, [F.asc(c) for c in order], parts)
    local = Window.partitionBy(*keys, _PART).orderBy(*order)
    taken = rows.withColumns({new: F.lag(old).over(local) for new, old in lags.items()})
    cut = _cut_keys(rows, keys)
    if not cut:
        return taken.select(*df.columns, *lags)
    # The last row of each part of a cut key; a key's first part has none before it.
    last = _of_keys(rows, keys, cut).groupBy(*keys, _PART).agg(
        F.max_by(F.struct(*lags.values()), F.struct(*order)).alias("_last"))
    carried = (last.withColumn("_carried", F.lag("_last").over(
        Window.partitionBy(*keys).orderBy(_PART))).filter("_carried IS NOT NULL").drop("_last"))
    taken = _with_carried(taken.withColumn("_first", F.row_number().over(local) == 1), keys,
                          carried)
    return taken.withColumns({
        new: F.when(F.col("_first"), F.col("_carried")[old]).otherwise(F.col(new))
        for new, old in lags.items()}).select(*df.columns, *lags)
