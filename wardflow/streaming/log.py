"""A log of changed rows that is merged while it is written.

Every batch adds a run: a folder with the rows that changed, the latest per key. As
soon as ``FAN`` runs stand on a level, they are merged into one run of the next level,
in which each key stands once. So there are at most ``FAN - 1`` runs on a level and a
logarithm of levels, and reading does not grow with the number of batches. A note
after each batch names the runs that count; a batch whose note is written is not
written again, and one that broke off leaves folders that no note names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from wardflow.functions import skew
from wardflow.sources.notes import last_note, write_note

FAN = 8
_BATCH = "_batch"


class ChangeLog:
    """The log under ``path`` of rows whose latest version per ``key`` counts."""

    def __init__(self, spark: SparkSession, path: str, key: str, fan: int = FAN):
        self._spark, self.path, self._key, self._fan = spark, path.rstrip("/"), key, fan

    def _last(self) -> tuple[int, list[list], StructType] | None:
        """Last batch, its runs (level, folder; the oldest first), and the rows' schema."""
        found = last_note(self._spark, f"{self.path}/notes")
        if found is None:
            return None
        return found[0], found[1]["runs"], StructType.fromJson(found[1]["schema"])

    def _read(self, folders: list[str], schema: StructType) -> DataFrame:
        return self._spark.read.schema(StructType([*schema.fields]).add(_BATCH, LongType())).parquet(
            *[f"{self.path}/{f}" for f in folders])

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _latest(self, rows: DataFrame) -> DataFrame:
        return skew.first_per_key(rows, [self._key], [F.desc(_BATCH)])

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch, one row per key; batches come in the order of their numbers."""
        last = self._last()
        if last is not None and last[0] >= batch_id:
            return
        runs = last[1] if last else []
        runs.append([0, self._write(batch.withColumn(_BATCH, F.lit(batch_id).cast("bigint")))])
        level = 0
        while len(own := [f for n, f in runs if n == level]) >= self._fan:
            merged = self._write(self._latest(self._read(own, batch.schema)))
            # Older runs, of higher levels, come first.
            runs = [r for r in runs if r[0] > level] + [[level + 1, merged]]
            level += 1
        write_note(self._spark, f"{self.path}/notes", batch_id,
                   {"runs": runs, "schema": batch.schema.jsonValue()})

    def runs(self) -> list[str]:
        """Folders that are read."""
        last = self._last()
        return [f for _, f in last[1]] if last else []

    def current(self) -> DataFrame:
        """The latest row of every key; the log must hold a batch."""
        _, runs, schema = self._last()
        rows = reduce(DataFrame.unionByName, [self._read([f], schema) for _, f in runs])
        return self._latest(rows).drop(_BATCH)
