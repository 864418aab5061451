"""Gapless places of rows within groups, without gathering a group.

A first pass gives each row its place among the rows of its group in its own
task. Groups then add what the earlier tasks hold, one row per group and task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow.session import settle


class Counter:
    """Places of a task's rows within groups numbered from 0."""

    def __init__(self, groups: int):
        self._rows = np.zeros(groups, np.int64)

    def places(self, group: np.ndarray) -> np.ndarray:
        order = np.argsort(group, kind="stable")
        ranked = group[order]
        head = np.searchsorted(ranked, ranked)
        out = np.empty(len(group), np.int64)
        out[order] = np.arange(len(group)) - head + self._rows[ranked]
        self._rows += np.bincount(group, minlength=len(self._rows))
        return out


def placed(rows: DataFrame, group: str, part: str, place: str) -> DataFrame:
    """``rows``, a written table, with ``place`` counted within the whole group.

    On entry ``place`` counts within (``group``, ``part``). Only ``part`` is dropped.
    """
    sizes = rows.groupBy(group, part).agg((F.max(place) + 1).alias("_rows"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = settle(sizes.select(group, part, F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
                                 .alias("_before")), "places")
    # Up to a row per group and task: too many to broadcast in a large job.
    return (rows.join(before.hint("merge"), [group, part]).withColumn(place, F.col(place) + F.col("_before"))
            .select(*[c for c in rows.columns if c != part]))
