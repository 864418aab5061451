"""Per-key operations that hold when one key owns a large part of the rows.

Aggregations combine before the shuffle and need no help. A plain join of two
tables is split by adaptive execution, but only if both sides come straight
from a shuffle, and a window puts every row of its key in one task. Here:

* Top-n per key filters on the rank, which Spark applies before the shuffle as
  well, so each task sends at most n rows per key.
* For joins, keys with very many rows are found first. Their rows meet the few
  matching parents by a broadcast join. All other keys take the ordinary join.
* A whole table is numbered in ranges of its number.

Places and previous rows within a key are in ``scan.py``.

Which keys are treated as hot never changes a result, only where the work runs.
If there are none, adaptive execution drops that part of the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is hot from about this many rows on.
HOT_ROWS = 1_000_000
# Upper bound of the broadcast list of such keys. A key outside the list has
# fewer rows than that, or less than 1/4096 of the table.
MAX_HOT_KEYS = 4096
# A key of HOT_ROWS rows is counted on about this many of them.
_COUNTED = 1000

_BUCKET = "_bucket"
_BEFORE = "_rows_before"


@dataclass(frozen=True)
class Split:
    """Rows of ordinary keys, rows of hot keys, and the list of the hot keys."""

    cold: DataFrame
    hot: DataFrame
    listed: DataFrame

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Split:
        return Split(change(self.cold), change(self.hot), self.listed)

    def whole(self) -> DataFrame:
        return self.cold.unionByName(self.hot)

    def join(self, parent: DataFrame, key: str, unique: bool = True) -> DataFrame:
        """Inner join to a parent table.

        A parent with unique keys has at most one row per listed key, which
        bounds what is broadcast. Otherwise Spark chooses by the size it finds.
        """
        return self.cold.join(parent, key).unionByName(self._hot_join(parent, key, unique))

    def outer(self, parent: DataFrame, key: str, unique: bool = True) -> DataFrame:
        """Every row of a parent table with its rows here, or with NULLs for none.

        A listed key has rows here, so its inner join loses no parent, and only the
        parents of ordinary keys are joined to the left of their few rows.
        """
        others = parent.join(F.broadcast(self.listed), key, "left_anti")
        return others.join(self.cold, key, "left").unionByName(self._hot_join(parent, key, unique))

    def _hot_join(self, parent: DataFrame, key: str, unique: bool) -> DataFrame:
        few = parent.join(F.broadcast(self.listed), key, "left_semi")
        return self.hot.join(F.broadcast(few) if unique else few, key)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  n: int = 1, position: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in the given order, which must be unique.

    ``position`` names an output column for the place.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    place = position or "_place"
    top = df.withColumn(place, F.row_number().over(window)).filter(F.col(place) <= n)
    return top if position else top.drop(place)


def latest_with_ties(df: DataFrame, keys: Sequence[str], moment: str, unique: Sequence[str],
                     hot_rows: int = HOT_ROWS) -> Split:
    """All rows of each key that share its latest ``moment``.

    Any number of rows may share it, for instance copies of one row. So a hot
    key's latest moment comes from an aggregation, and its rows from a join.
    """
    split = split_hot(df, keys, unique, hot_rows)
    window = Window.partitionBy(*keys).orderBy(F.desc(moment))
    cold = (split.cold.withColumn("_place", F.rank().over(window)).filter(F.col("_place") == 1)
            .drop("_place"))
    # One row per listed key.
    latest = F.broadcast(split.hot.groupBy(*keys).agg(F.max(moment).alias(moment)))
    return Split(cold, split.hot.join(latest, [*keys, moment]).select(*df.columns), split.listed)


def hot_keys(df: DataFrame, keys: Sequence[str], unique: Sequence[str],
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with ``hot_rows`` rows or more, at most ``MAX_HOT_KEYS`` of them.

    Rows are counted on a fixed share, chosen by a hash of the ``unique``
    columns: the same rows on every run, and a thousandth of the shuffle of a
    full count. The limit is half of what a key of ``hot_rows`` rows is
    expected to show, so such a key is not missed; a smaller one may be listed.
    """
    share = max(1, hot_rows // _COUNTED)
    counted = df if share == 1 else df.filter(F.xxhash64(*unique) % share == 0)
    least = hot_rows if share == 1 else _COUNTED // 2
    return (counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
            .filter(F.col("_rows") >= least)
            .orderBy(F.desc("_rows"), *keys).limit(MAX_HOT_KEYS)
            .select(*keys))


def split_hot(df: DataFrame, keys: Sequence[str], unique: Sequence[str],
              hot_rows: int = HOT_ROWS) -> Split:
    """``df`` by ordinary and hot keys; the two parts are all its rows."""
    listed = hot_keys(df, keys, unique, hot_rows)
    keys = list(keys)
    return Split(df.join(F.broadcast(listed), keys, "left_anti"),
                 df.join(F.broadcast(listed), keys, "left_semi"), listed)


def id_bucket(number: Column, width: int = HOT_ROWS) -> Column:
    """Bucket for rows ordered by an ascending unique number."""
    return F.floor(number / width)


def number_table(df: DataFrame, number: str, name: str, width: int = HOT_ROWS) -> DataFrame:
    """Number all rows from 1 along a unique whole number.

    A bucket holds ``width`` numbers and a range ``width`` buckets, so however
    the numbers lie, no task orders more than ``width`` rows, except for one
    with a row per range.
    """
    cut = df.withColumn(_BUCKET, id_bucket(F.col(number), width))
    sizes = (cut.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("_rows"))
             .withColumn("_range", id_bucket(F.col(_BUCKET), width)))

    def earlier(window: Window) -> Column:
        window = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_rows").over(window), F.lit(0))

    ranges = (sizes.groupBy("_range").agg(F.sum("_rows").alias("_rows"))
              .select("_range", earlier(Window.orderBy("_range")).alias("_before_range")))
    within = earlier(Window.partitionBy("_range").orderBy(_BUCKET))
    before = (sizes.withColumn(_BEFORE, within).join(ranges, "_range")
              .select(_BUCKET, (F.col(_BEFORE) + F.col("_before_range")).alias(_BEFORE)))
    local = Window.partitionBy(_BUCKET).orderBy(number)
    return (cut.withColumn(name, F.row_number().over(local)).join(before, _BUCKET)
            .withColumn(name, F.col(name) + F.col(_BEFORE))
            .select(*df.columns, name))
