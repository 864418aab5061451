"""Shards by fixed virtual slots and a versioned map from slot to shard.

A row's slot is a hash of its id, checksum and size, and never changes. Bytes
are summed per slot. The first map deals the slots out in turn; rebalancing
edits a few of its entries, so few rows move: slots go from the fullest shard to
the emptiest, each the one that evens the two out best, until no move helps. The
map has an entry per slot, whatever the number of rows, and every edit is stored
as a new version.

Law: ``bytes``. Sizes of the shards are as near to each other as whole slots
allow; rows that are equal in id and text share a slot.

Defined results: a null text has 8 bytes and checksum 0; null ids are hashed as
such; repeated rows are placed each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardflow.llm.places import Counter, placed
from wardflow.session import run_dir, settle

SLOTS = 8192
SHARDS = 24
ROW_BYTES = 8


def virtual_slot(slots: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def first_map(slots: int, shards: int) -> np.ndarray:
    """Version 0: the slots dealt out in turn."""
    return np.arange(slots) % shards


def rebalanced(shard_of: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """The next version of a map, with the sizes of the shards evened out."""
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, weights=size, minlength=shards).astype(np.int64)
    while True:
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        own = np.flatnonzero((shard_of == full) & (size > 0) & (size < gap))
        best, move = gap, None
        if len(own):
            k = own[np.abs(gap - 2 * size[own]).argmin()]
            best, move = abs(gap - 2 * size[k]), (k, None)
        # Or two slots change places: the pair whose difference is nearest to half the gap.
        give = np.flatnonzero((shard_of == full) & (size > 0))
        take = np.flatnonzero((shard_of == empty) & (size > 0))
        if len(give) and len(take):
            take = take[np.argsort(size[take], kind="stable")]
            at = np.searchsorted(size[take], size[give] - gap / 2)
            for k in (np.clip(at - 1, 0, len(take) - 1), np.clip(at, 0, len(take) - 1)):
                after = np.abs(gap - 2 * (size[give] - size[take[k]]))
                i = int(after.argmin())
                if after[i] < best:
                    best, move = after[i], (give[i], take[k[i]])
        if move is None or best >= gap:
            return shard_of
        for slot, source, target in ((move[0], full, empty), (move[1], empty, full)):
            if slot is not None:
                shard_of[slot] = target
                load[source] -= size[slot]
                load[target] += size[slot]


def save_map(spark: SparkSession, shard_of: np.ndarray, size: np.ndarray, path: str,
             version: int) -> None:
    """Store one version of a map, with the bytes it was made for."""
    rows = [(i, int(shard), int(n)) for i, (shard, n) in
            enumerate(zip(shard_of, size, strict=True))]
    (spark.createDataFrame(rows, "slot int, shard int, bytes long").coalesce(1)
     .write.parquet(f"{path}/version={version}"))


def load_map(spark: SparkSession, path: str, version: int) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("slot").collect()
    return np.array([r["shard"] for r in rows], np.int64)


def measured(docs: DataFrame, doc_id: str, text: str, slots: int) -> DataFrame:
    """Size, checksum and slot of every row, numbered within slot and task."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("virtual_slot", virtual_slot(slots, "doc_id", "text_crc32", "size"))
    schema = StructType(list(rows.schema.fields)).add("slot", "long").add("part", "integer")

    def run(batches):
        part, counter = TaskContext.get().partitionId(), Counter(slots)
        for batch in batches:
            place = counter.places(batch.column(3).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place),
                 pa.array(np.full(batch.num_rows, part, np.int32))], names=schema.names)

    return settle(rows.mapInArrow(run, schema), "slotted")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, doc_id: str = "doc_id",
          text: str = "text", path: str | None = None) -> DataFrame:
    """Shard of every row and its place there (``slot``, gapless from 0).

    The map's versions are stored in ``path``, a new shared folder by default:
    0 before, 1 after rebalancing.
    """
    spark = docs.sparkSession
    path = path or run_dir(spark, "slot-map")
    rows = measured(docs, doc_id, text, slots)
    size, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    # At most one row per slot.
    for row in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"),
                                                F.count(F.lit(1)).alias("rows")).collect():
        size[row["virtual_slot"]], count[row["virtual_slot"]] = row["bytes"], row["rows"]
    save_map(spark, first_map(slots, shards), size, path, 0)
    save_map(spark, rebalanced(first_map(slots, shards), size, shards), size, path, 1)
    shard_of = load_map(spark, path, 1)
    before = np.zeros(slots, np.int64)
    for k in range(shards):
        own = np.flatnonzero(shard_of == k)
        before[own] = np.cumsum(count[own]) - count[own]
    # One row per slot: bounded by the number of slots.
    lookup = F.broadcast(spark.createDataFrame(
        [(i, int(s), int(b)) for i, (s, b) in enumerate(zip(shard_of, before, strict=True))],
        "virtual_slot int, shard int, _first long"))
    return (placed(rows, "virtual_slot", "part", "slot").join(lookup, "virtual_slot")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("slot") + F.col("_first")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))
