"""The vitals feed as a stream: checked records, and the abnormal list kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardflow.operators import quality, reports
from wardflow.streaming.log import ChangeLog


def validate_vitals_stream(stream: DataFrame, patients: DataFrame) -> DataFrame:
    """The checks of the batch job on a stream, against the patients table."""
    return quality.check_vitals(stream, patients)


def write_checked(checked: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived, accepted and rejected rows in folders of their own.

    One file sink takes both, so every record is checked once and lands exactly
    once. The checkpoint belongs in a folder the cluster shares.
    """
    status = F.when(F.col(quality.REASON).isNull(), "accepted").otherwise("rejected")
    return (checked.withColumn("status", status).writeStream
            .partitionBy("status").format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def abnormal_vitals_stream(stream: DataFrame, min_count: int = 2) -> DataFrame:
    """The abnormal-vitals summary over the whole feed so far.

    State is one row of sums per patient. It covers all time, so there is no
    watermark.
    """
    return reports.vitals_summary(stream, min_count)


def write_changes(summary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add the changed summary rows of each batch to a log under ``path``.

    A batch that is run again after a restart is not added twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        ChangeLog(batch.sparkSession, path, "patient_id").append(batch, batch_id)

    return (summary.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_summary(spark: SparkSession, path: str) -> DataFrame:
    """The latest row per patient of the log under ``path``."""
    return ChangeLog(spark, path, "patient_id").current()
