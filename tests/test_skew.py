"""Hot keys: the same results however the work is cut."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import TODAY, hospital, patient
from wardflow.functions import scan, skew
from wardflow.operators import features, profile, quality, reports

START = datetime(2000, 1, 1)


@pytest.fixture(scope="module")
def crowded(spark):
    """One patient holds a third of all rows, with shared times; another half a dozen."""
    vitals, number = [], 0
    for key, rows, step in (("hot", 300, 7), ("warm", 6, 500), *((f"p{i}", 6, 900)
                                                                 for i in range(100))):
        for i in range(rows):
            number += 1
            vitals.append({"vital_id": number, "patient_id": key,
                           "recorded_at": START + timedelta(minutes=step * (i // 2)),
                           "heart_rate": 60 + number % 40, "temperature": None,
                           "blood_pressure_systolic": 100 + number % 60,
                           "blood_pressure_diastolic": 60 + number % 40})
    keys = sorted({v["patient_id"] for v in vitals})
    return hospital(
        spark, patients=[patient(k, date(1980, 1, 1), gender="Female") for k in keys],
        vitals=vitals,
        appointments=[{"appointment_id": v["vital_id"], "patient_id": v["patient_id"],
                       "appointment_date": v["recorded_at"]} for v in vitals],
        delivery_information=[
            {"delivery_id": v["vital_id"], "patient_id": v["patient_id"],
             "delivery_date": None if v["vital_id"] % 9 == 0 else v["recorded_at"].date()}
            for v in vitals if v["vital_id"] % 2])


def by_patient(rows, order):
    groups = {}
    for row in sorted(rows, key=order):
        groups.setdefault(row.patient_id, []).append(row)
    return groups


def test_hot_keys_lists_only_large_keys(crowded):
    found = skew.hot_keys(crowded["vitals"], ["patient_id"], ["vital_id"], hot_rows=100)
    assert [r.patient_id for r in found.collect()] == ["hot"]
    assert skew.hot_keys(crowded["vitals"], ["patient_id"], ["vital_id"]).count() == 0


def test_hot_keys_on_a_share_of_the_rows(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("key"), "id")
    found = skew.hot_keys(rows, ["key"], ["id"], hot_rows=20_000)
    assert [r.key for r in found.collect()] == [-1]


def test_split_is_whole(crowded):
    split = skew.split_hot(crowded["vitals"], ["patient_id"], ["vital_id"], 100)
    assert (split.cold.count(), split.hot.count(), split.listed.count()) == (606, 300, 1)


@pytest.mark.parametrize("parts", [None, 1, 4, 60])
def test_numbering(crowded, parts):
    df = scan.numbered(crowded["vitals"], ["patient_id"],
                       [F.desc("recorded_at"), F.desc("vital_id")], "place", parts)
    groups = by_patient(df.collect(), lambda r: (-r.recorded_at.timestamp(), -r.vital_id))
    assert sum(map(len, groups.values())) == 906
    for rows in groups.values():
        assert [r.place for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("parts", [None, 1, 4, 60])
def test_numbering_with_missing_dates(crowded, parts):
    df = scan.numbered(crowded["delivery_information"], ["patient_id"],
                       [F.desc("delivery_date"), F.desc("delivery_id")], "place", parts)
    groups = by_patient(df.collect(), lambda r: (
        r.delivery_date is None, -(r.delivery_date or TODAY).toordinal(), -r.delivery_id))
    for rows in groups.values():
        assert [r.place for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("moment", [None, START])
def test_rows_of_one_moment_lie_in_several_parts(spark, moment):
    """A patient whose rows all share a time, or have none, is no single task's work."""
    rows = [(k, n, moment) for k, size in (("hot", 3000), ("a", 2), (None, 40), ("z", 1))
            for n in range(size)]
    df = spark.createDataFrame(rows, "key string, id long, at timestamp_ntz").repartition(5)
    dealt = scan._dealt(df, ["key"], [F.asc("at"), F.asc("id")], 8)
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    assert scan._cut_keys(dealt, ["key"]) == [("hot",)]
    order = [F.asc("at"), F.asc("id")]
    assert all(r.place == r.id + 1
               for r in scan.numbered(df, ["key"], order, "place", 8).collect())
    lags = scan.lagged(df, ["key"], ["at", "id"], {"before": "id", "then": "at"}, 8).collect()
    assert len(lags) == 3043
    for r in lags:
        assert r.before == (r.id - 1 if r.id else None)
        assert r.then == (moment if r.id else None)


def test_scans_of_an_empty_table(spark):
    df = spark.createDataFrame([], "key string, id long")
    assert scan.numbered(df, ["key"], [F.asc("id")], "place").collect() == []
    assert scan.lagged(df, ["key"], ["id"], {"before": "id"}).collect() == []


@pytest.mark.parametrize("width", [10, skew.HOT_ROWS])
def test_numbering_a_whole_table(spark, width):
    ids = [*range(-50, 3000, 7), 10 ** 6, 2 ** 62]
    df = skew.number_table(spark.createDataFrame([(i,) for i in ids], "id bigint"), "id",
                           "place", width)
    assert [(r.id, r.place) for r in df.orderBy("id").collect()] == [
        (i, n) for n, i in enumerate(ids, start=1)]


@pytest.mark.parametrize("parts", [None, 1, 4, 60])
def test_lag(crowded, parts):
    rows = scan.lagged(crowded["vitals"], ["patient_id"], ["recorded_at", "vital_id"],
                       {"before": "vital_id"}, parts).collect()
    groups = by_patient(rows, lambda r: (r.recorded_at, r.vital_id))
    assert len(rows) == 906
    for group in groups.values():
        assert [r.before for r in group] == [None, *[r.vital_id for r in group][:-1]]


@pytest.mark.parametrize("hot_rows", [1, 100])
def test_latest_with_ties(crowded, hot_rows):
    def latest(rows):
        df = skew.latest_with_ties(crowded["vitals"], ["patient_id"], "recorded_at",
                                   ["vital_id"], rows)
        return sorted(r.vital_id for r in df.whole().collect())

    assert latest(hot_rows) == latest(skew.HOT_ROWS)
    assert len(latest(hot_rows)) == 2 * 102


@pytest.mark.parametrize("hot_rows", [1, 100])
def test_operators_do_not_depend_on_hot_keys(crowded, hot_rows):
    for run in (lambda **k: reports.high_risk(crowded, TODAY, **k),
                lambda **k: features.risk_features(crowded, TODAY, **k)):
        assert sorted(map(str, run(hot_rows=hot_rows).collect())) == sorted(
            map(str, run().collect()))


def test_profile_pages_are_whole_and_bounded(crowded):
    rows = profile.patient_profile(crowded, "hot", page_size=40).orderBy("page").collect()
    assert [r.page for r in rows] == list(range(8))
    listed = [v for r in rows for v in r.vitals]
    assert len(listed) == 300
    assert max(len(r.vitals) for r in rows) == 40
    assert [(v.recorded_at, v.vital_id) for v in listed] == sorted(
        ((v.recorded_at, v.vital_id) for v in listed), reverse=True)
    deliveries = [d.delivery_id for r in rows for d in r.delivery_information]
    assert deliveries == sorted(deliveries) and len(deliveries) == 150


def test_profile_of_a_patient_without_entries(spark):
    t = hospital(spark, patients=[patient("A", date(1980, 1, 1))],
                 vitals=[{"vital_id": 1, "patient_id": "nobody", "recorded_at": START}])
    rows = profile.patient_profile(t).collect()
    assert [(r.patient_id, r.page, r.vitals, r.medications) for r in rows] == [("A", 0, [], [])]
    assert profile.patient_profile(t, "B").count() == 0


@pytest.fixture
def settings(spark):
    """Sets session options for one test."""
    before = {}

    def put(**values):
        for key, value in values.items():
            key = "spark.sql." + key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


def final_plan(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_hot_key_of_a_plain_join_is_split(spark, tmp_path, settings):
    """Adaptive execution splits the partition of a patient with most of a feed."""
    settings(autoBroadcastJoinThreshold="-1", files__maxPartitionBytes="64KB",
             files__openCostInBytes="64KB", adaptive__coalescePartitions__enabled="false",
             adaptive__skewJoin__skewedPartitionThresholdInBytes="4KB",
             adaptive__skewJoin__skewedPartitionFactor="1.5",
             adaptive__advisoryPartitionSizeInBytes="4KB")
    raw = spark.range(30_000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id")))
        .alias("patient_id"), F.lit("36.6").alias("temperature"))
    raw.repartition(16).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    checked = quality.check_vitals(raw, raw.select("patient_id").distinct())
    plan = final_plan(quality.check_vitals(raw, spark.createDataFrame([("hot",)], "patient_id string")))
    assert "skew=true" in plan
    assert quality.accepted(checked).count() == 30_000


def test_hot_patients_are_joined_by_broadcast(crowded, settings):
    settings(autoBroadcastJoinThreshold="-1")
    visits = crowded["appointments"].select(
        F.col("appointment_id").alias("visit_id"), "patient_id",
        F.col("appointment_date").cast("date").alias("visit_date"),
        F.lit(True).alias("follow_up_required"),
        F.lit(date(2001, 6, 1)).alias("follow_up_date"))
    t = {**crowded, "follow_up_visits": visits}
    hot = reports.missed_follow_ups(t, TODAY, hot_rows=100)
    assert hot.count() == 906
    assert final_plan(hot).count("BroadcastHashJoin [patient_id") == 4
    # With no hot patient, nothing of that part is left in the plan.
    plan = final_plan(reports.missed_follow_ups(t, TODAY))
    assert "BroadcastHashJoin" not in plan and "Union" not in plan


def test_patients_without_timed_readings_have_one_row(spark):
    silent, untimed = patient("S", date(1980, 1, 1)), patient("U", date(1980, 1, 1))
    t = hospital(spark, patients=[silent, untimed],
                 vitals=[{"vital_id": 1, "patient_id": "U"}, {"vital_id": 2, "patient_id": "U"}])
    for hot_rows in (1, skew.HOT_ROWS):
        rows = reports.high_risk(t, TODAY + timedelta(days=20_000), hot_rows=hot_rows).collect()
        assert sorted(r.patient_id for r in rows) == ["S", "U"]
