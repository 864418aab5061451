"""Tables kept in files by a hash of their key, changed bucket by bucket.

A table is a folder of data folders and numbered notes. The last note names, for
every bucket, the folder that holds its rows. A lookup by key reads one bucket, and a
change rewrites the touched buckets only: it writes their new files, then the next
note. Readers see the note before or the note after. A change that breaks off leaves
files that no note names. Two writers cannot both write the same next note.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from wardflow.sources.notes import last_note, write_note

_BUCKET = "_bucket"


class ClusteredTable:
    """Rows under ``path`` in at most ``buckets`` files' worth of folders by ``key``."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")
        found = last_note(spark, f"{self.path}/notes")
        if found is None:
            raise FileNotFoundError(f"no clustered table at {path}")
        self.version, note = found
        self.key: str = note["key"]
        self.buckets: int = note["buckets"]
        self.schema = StructType.fromJson(note["schema"])
        # Bucket number to the folder of its rows; buckets without rows are absent.
        self._folders: dict[int, str] = {int(b): f for b, f in note["folders"].items()}

    # -- writing ----------------------------------------------------------------

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int) -> ClusteredTable:
        """Write ``df`` as version 1."""
        table = cls.__new__(cls)
        table._spark, table.path = df.sparkSession, path.rstrip("/")
        table.version, table.key, table.buckets = 0, key, buckets
        table.schema, table._folders = df.schema, {}
        table._put(df, range(buckets))
        return table

    def _put(self, rows: DataFrame, touched: Iterable[int]) -> None:
        """Make ``rows`` the whole content of the touched buckets."""
        folder = f"data/{uuid.uuid4().hex}"
        cut = rows.select(*self.schema.names).withColumn(_BUCKET, self._bucket(F.col(self.key)))
        # Adaptive execution splits a bucket with very many rows among tasks.
        (cut.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET)
         .parquet(f"{self.path}/{folder}"))
        folders = {b: f for b, f in self._folders.items() if b not in set(touched)}
        # Which buckets got rows is read off the names of their folders.
        found = (self._spark.read.schema(StructType([*self.schema.fields]).add(_BUCKET, IntegerType()))
                 .parquet(f"{self.path}/{folder}"))
        folders |= {row[0]: folder for row in found.select(_BUCKET).distinct().collect()}
        write_note(self._spark, f"{self.path}/notes", self.version + 1, {
            "key": self.key, "buckets": self.buckets, "schema": self.schema.jsonValue(),
            "folders": folders})
        self.version, self._folders = self.version + 1, folders

    def change(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the buckets of ``keys`` by what ``change`` makes of their rows.

        ``change`` gets the rows of those buckets and may add rows whose keys are in
        ``keys``. At most as many numbers as there are buckets come to the driver.
        """
        key = keys.select(keys.columns[0]).toDF("_key")
        touched = [r[0] for r in key.select(self._bucket(F.col("_key"))).distinct().collect()]
        if touched:
            self._put(change(self._of(touched)), touched)

    def upsert(self, rows: DataFrame) -> None:
        """Rows with keys of the table replace those; others are added."""
        rows = rows.select(*self.schema.names)
        self.change(rows.select(self.key), lambda old: old.join(
            rows.select(self.key), self.key, "left_anti").unionByName(rows))

    def delete(self, keys: DataFrame) -> None:
        """Remove the rows with a listed key; ``keys`` has the column of the key."""
        self.change(keys.select(self.key), lambda old: old.join(
            keys.select(self.key), self.key, "left_anti"))

    # -- reading ----------------------------------------------------------------

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)),
                      F.lit(self.buckets)).cast("int")

    def _of(self, buckets: Iterable[int]) -> DataFrame:
        paths = sorted({f"{self.path}/{self._folders[b]}/{_BUCKET}={b}"
                        for b in buckets if b in self._folders})
        if not paths:
            return self._spark.createDataFrame([], self.schema)
        return self._spark.read.schema(self.schema).parquet(*paths)

    def rows(self) -> DataFrame:
        """All rows of the version this object has read or written."""
        return self._of(range(self.buckets))

    def lookup(self, *keys: object) -> DataFrame:
        """The rows with one of the keys; only their buckets are read."""
        of = self.schema[self.key].dataType
        wanted = self._spark.createDataFrame([(k,) for k in keys], StructType().add("_key", of))
        found = wanted.select(self._bucket(F.col("_key"))).distinct().collect()
        return self._of([r[0] for r in found]).filter(F.col(self.key).isin(*keys))

    def semi(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is listed; only buckets of listed keys are read."""
        found = keys.select(self._bucket(F.col(self.key))).distinct().collect()
        return self._of([r[0] for r in found]).join(keys.select(self.key), self.key, "left_semi")
