"""The vitals feed: the stream must give what the batch job gives."""

import random

import pytest
from pyspark.sql import functions as F

from wardflow.operators import quality, reports
from wardflow.sources.derived import HospitalTables
from wardflow.streaming import vitals as feed
from wardflow.streaming.log import ChangeLog

SF_DIR = "/root/testdata/sf0.001"


def arrive(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(folder)


def read_stream(spark, rows, folder):
    return (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder))


def test_checked_feed_equals_batch_over_several_runs(spark, tmp_path):
    t = HospitalTables(spark, SF_DIR)
    raw = t["raw_vitals"]
    batch = quality.check_vitals(raw, t["patients"])
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in range(3):
        arrive(raw.filter(F.col("row_id") % 3 == part), folder)
        stream = feed.validate_vitals_stream(read_stream(spark, raw, folder), t["patients"])
        feed.write_checked(stream, out, f"{tmp_path}/checkpoint").awaitTermination()
    written = spark.read.parquet(out)
    assert written.count() == raw.count()
    assert not written.select(batch.columns).exceptAll(batch).count()
    counts = {r.status: r["count"] for r in written.groupBy("status").count().collect()}
    assert counts == {"accepted": 761, "rejected": 739}


def test_summary_is_kept_current(spark, tmp_path):
    t = HospitalTables(spark, SF_DIR)
    vitals = t["vitals"]
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in range(3):
        arrive(vitals.filter(F.col("vital_id") % 3 == part), folder)
        stream = feed.abnormal_vitals_stream(read_stream(spark, vitals, folder))
        feed.write_changes(stream, out, f"{tmp_path}/checkpoint").awaitTermination()
        current = feed.current_summary(spark, out)
        batch = reports.vitals_summary(vitals.filter(F.col("vital_id") % 3 <= part))
        assert not current.exceptAll(batch).count()
        assert current.count() == batch.count()


def test_a_log_of_many_batches_stays_small(spark, tmp_path):
    rng, path, want, most = random.Random(1), f"{tmp_path}/log", {}, 0
    for batch in range(50):
        rows = {rng.randrange(40): f"{batch}" for _ in range(6)}
        want |= rows
        # A log opened anew each time, as after a restart.
        log = ChangeLog(spark, path, "id", fan=3)
        log.append(spark.createDataFrame(list(rows.items()), "id long, v string").coalesce(1), batch)
        if batch % 7 == 0:  # run again: nothing is added
            log.append(spark.createDataFrame([(1, "again")], "id long, v string"), batch)
        most = max(most, len(log.runs()))
    assert most <= 2 * 4  # two runs on each of four levels
    rows = log.current().collect()
    assert {r.id: r.v for r in rows} == want and len(rows) == len(want)


def test_a_batch_that_breaks_off_is_added_when_it_is_run_again(spark, tmp_path):
    log = ChangeLog(spark, f"{tmp_path}/log", "id")
    log.append(spark.createDataFrame([(1, "a")], "id long, v string"), 0)
    broken = spark.createDataFrame([(1, "b")], "id long, v string").withColumn(
        "v", F.raise_error(F.lit("broken off")).cast("string"))
    with pytest.raises(Exception, match="broken off"):
        log.append(broken, 1)
    assert [r.v for r in log.current().collect()] == ["a"]
    log.append(spark.createDataFrame([(1, "b"), (2, "c")], "id long, v string"), 1)
    assert sorted(map(tuple, log.current().collect())) == [(1, "b"), (2, "c")]
