"""Numbered notes in the shared folder: each one a small JSON text, written once.

A note commits what was written before it. Its folder is new, so of two writers of
the same number one fails.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def write_note(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    (spark.range(1).select(F.lit(json.dumps(content)).alias("value")).coalesce(1)
     .write.text(f"{folder}/{number:010d}"))


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers in a folder by its listing; their texts are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit())


def last_note(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The note with the highest number that was written whole."""
    for number in reversed(_numbers(spark, folder)):
        try:
            row = spark.read.text(f"{folder}/{number:010d}").first()
        except AnalysisException:
            continue
        if row is not None:
            return number, json.loads(row["value"])
    return None
