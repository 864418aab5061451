"""Appends, partial updates and deletes, and writing their results."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from helpers import hospital, patient, table
from wardflow.operators import quality as Q
from wardflow.operators import updates as U
from wardflow.sources.schemas import TABLES
from wardflow.sources.tables import json_rows, read_tables, write_json, write_table

NOW = datetime(2002, 1, 1, 8, 30)
BORN = date(1980, 1, 1)


def changes(spark, *rows):
    return spark.createDataFrame(
        [(i, key, fields) for i, (key, fields) in enumerate(rows)],
        "change_id bigint, patient_id string, fields map<string,string>")


def test_append_vitals_continues_the_ids(spark):
    accepted = spark.createDataFrame(
        [(9, "A", "36.65", "80", None), (5, "B", None, " 90 ", datetime(2001, 1, 1)),
         (2_000_007, "A", "4e1", None, None)],
        "row_id bigint, patient_id string, temperature string, heart_rate string, "
        "recorded_at timestamp_ntz")
    vitals = table(spark, "vitals", [{"vital_id": 41, "patient_id": "A", "recorded_at": NOW}])
    rows = U.append_vitals(accepted, vitals, NOW).orderBy("vital_id").collect()
    assert [(r.vital_id, r.patient_id, r.recorded_at, str(r.temperature), r.heart_rate)
            for r in rows] == [
        (42, "B", datetime(2001, 1, 1), "None", 90), (43, "A", NOW, "36.65", 80),
        (44, "A", NOW, "40.00", None)]
    first = U.append_vitals(accepted.drop("recorded_at"), table(spark, "vitals", []), NOW)
    assert sorted((r.vital_id, r.recorded_at) for r in first.collect()) == [
        (1, NOW), (2, NOW), (3, NOW)]


def test_new_patient_ids(spark):
    accepted = spark.range(50).select(
        F.col("id").alias("row_id"), F.lit("Pat").alias("first_name"),
        F.lit("Lee").alias("last_name"), F.lit("1990-2-3").alias("date_of_birth"))
    none = table(spark, "patients", [])
    first = U.append_patients(accepted, none, "1", NOW)
    rows = first.collect()
    ids = {r.patient_id for r in rows}
    assert len(ids) == 50
    assert all(len(i) == 33 and i[0] == "P" and int(i[1:], 16) >= 0 and i == i.upper()
               for i in ids)
    assert rows[0].date_of_birth == date(1990, 2, 3) and rows[0].created_at == NOW
    again = {r.patient_id for r in U.append_patients(accepted, none, "1", NOW).collect()}
    other = {r.patient_id for r in U.append_patients(accepted, none, "2", NOW).collect()}
    assert again == ids and len(other) == 50 and not other & ids
    # What has landed is not added again, also if it was changed since; the rest is.
    landed = table(spark, "patients", [patient(i, BORN) for i in sorted(ids)[:20]])
    rest = {r.patient_id for r in U.append_patients(accepted, landed, "1", NOW).collect()}
    assert rest == set(sorted(ids)[20:])
    # Three batches that number their rows alike, each run twice.
    stored = none
    for batch in ("1", "1", "2", "2", "3", "3"):
        stored = stored.unionByName(U.append_patients(accepted, stored, batch, NOW),
                                    allowMissingColumns=True)
    assert stored.count() == stored.select("patient_id").distinct().count() == 150


def test_partial_update(spark):
    patients = table(spark, "patients", [
        patient("A", BORN, city="Oslo", phone="1", updated_at=datetime(2000, 1, 1)),
        patient("B", BORN, city="Rome", updated_at=datetime(2000, 1, 1)),
        patient("C", BORN, updated_at=datetime(2000, 1, 1))])
    requests = changes(
        spark,
        ("A", {"city": "Bern", "phone": "2"}),
        ("A", {"city": None}),                              # later, and explicitly NULL
        ("B", {"city": "Rome", "patient_id": "Z"}),         # the key does not change
        ("nobody", {"city": "x"}),
        ("C", {}), ("C", {"patient_id": "Z"}),
        ("C", {"first_name": None}), ("C", {"last_name": "x" * 101}),
        ("C", {"date_of_birth": "1990-02-30"}), ("C", {"date_of_birth": None}),
        ("C", {"nickname": "x"}), ("C", {"phone": "x" * 21}),
        ("C", {"date_of_birth": "1990-2-3"}))
    after, refused = U.partial_update(patients, requests, NOW)
    rows = {r.patient_id: r for r in after.collect()}
    assert set(rows) == {"A", "B", "C"}
    assert (rows["A"].city, rows["A"].phone, rows["A"].updated_at) == (None, "2", NOW)
    # A value that stays the same is not an update.
    assert (rows["B"].city, rows["B"].updated_at) == ("Rome", datetime(2000, 1, 1))
    assert rows["C"].date_of_birth == date(1990, 2, 3)
    assert after.columns == patients.columns
    assert [r[Q.REASON] for r in refused.orderBy("change_id").collect()] == [
        "Patient not found", "No fields to update", "No fields to update", "Invalid first_name",
        "Invalid last_name", "Invalid date_of_birth format", "Invalid date_of_birth format",
        "Unknown field", "Too long: phone"]


def test_delete_by_key(spark):
    keys = spark.createDataFrame([(1,), (1,), (7,)], "id bigint")
    assert [r.id for r in U.delete_by_key(spark.range(4), keys, "id").collect()] == [0, 2, 3]


def test_tables_round_trip(spark, tmp_path):
    t = hospital(spark, patients=[patient("A", BORN)], appointments=[
        {"appointment_id": 1, "patient_id": "A", "appointment_date": NOW}])
    write_table(t["patients"], str(tmp_path), "patients")
    write_table(t["appointments"].drop("status"), str(tmp_path), "appointments")
    new = table(spark, "patients", [patient("B", BORN)]).drop("notes", "zip_code")
    write_table(new, str(tmp_path), "patients", mode="append")
    read = read_tables(spark, str(tmp_path), ["patients", "appointments"])
    assert sorted(r.patient_id for r in read["patients"].collect()) == ["A", "B"]
    assert read["appointments"].first().status == "Scheduled"
    assert read["patients"].schema == TABLES["patients"].schema
    with pytest.raises(Exception, match="exists"):
        write_table(t["patients"], str(tmp_path), "patients")


def test_json_has_iso_dates_and_nulls(spark, tmp_path):
    t = hospital(spark, patients=[patient("A", BORN, created_at=NOW)])
    df = t["patients"].select("patient_id", "date_of_birth", "created_at", "email")
    expected = {"patient_id": "A", "date_of_birth": "1980-01-01",
                "created_at": "2002-01-01T08:30:00", "email": None}
    assert json.loads(json_rows(df).first().json) == expected
    write_json(df, f"{tmp_path}/out")
    assert json.loads(spark.read.text(f"{tmp_path}/out").first().value) == expected
