"""Columns carried by place, so that no name of theirs can clash or be misread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Carried:
    """``df`` with its columns named by place; names may hold dots or repeat."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.rows = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        """The name by place of the first column called ``name``."""
        return f"c{self.names.index(name)}"

    def back(self, df: DataFrame, **replaced: str) -> DataFrame:
        """The carried columns under their own names; some taken from others of ``df``."""
        return df.select(*[F.col(replaced.get(f"c{i}", f"c{i}")).alias(name)
                           for i, name in enumerate(self.names)])
