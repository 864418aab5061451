"""Checks of incoming records, and the audit."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import hospital, patient, table
from wardflow.operators import quality as Q
from wardflow.sources.derived import HospitalTables

BORN = date(1980, 1, 1)


def reasons(checked, key="row_id"):
    return {r[key]: r[Q.REASON] for r in checked.collect()}


@pytest.mark.parametrize("column, good, invalid, outside", [
    ("temperature", ["30", "45", "36.6", " 36.6 ", "+4e1", "45.", None],
     ["abc", "", "36,6", "0x24", "36.6f"], ["29.99", "45.1", "nan", "-inf", "Infinity"]),
    ("heart_rate", ["30", "220", " 80 ", "+80", "080", None],
     ["72.5", "abc", "", "8e1", "nan"], ["29", "221", "-80", "99999999999999999999"]),
    ("blood_pressure_systolic", ["70", "250", None], ["70.0", "x"], ["69", "251"]),
    ("blood_pressure_diastolic", ["40", "150", None], ["40.0", "x"], ["39", "151"]),
])
def test_reading_limits(spark, column, good, invalid, outside):
    values = [*good, *invalid, *outside]
    raw = spark.createDataFrame([(i, "A", v) for i, v in enumerate(values)],
                                f"row_id int, patient_id string, {column} string")
    known = table(spark, "patients", [patient("A", BORN)])
    found = reasons(Q.check_vitals(raw, known))
    kinds = {v: ("fine" if r is None else "invalid" if r.startswith("Invalid") else "outside")
             for v, r in zip(values, [found[i] for i in range(len(values))], strict=True)}
    assert kinds == {**dict.fromkeys(good, "fine"), **dict.fromkeys(invalid, "invalid"),
                     **dict.fromkeys(outside, "outside")}


def test_first_fault_is_the_reason(spark):
    raw = spark.createDataFrame(
        [(1, "nobody", "abc", "29"), (2, "nobody", "36", "29"), (3, "nobody", "36", "80"),
         (4, None, "36", "80")],
        "row_id int, patient_id string, temperature string, heart_rate string")
    found = reasons(Q.check_vitals(raw, table(spark, "patients", [patient("A", BORN)])))
    assert found == {1: "Invalid temperature value", 2: "Heart rate out of range (30-220)",
                     3: "Patient not found", 4: "Patient not found"}


def test_time_sent_as_null_is_refused(spark):
    raw = spark.createDataFrame(
        [(1, "A", None, True), (2, "A", None, False), (3, "A", datetime(2001, 1, 1), True)],
        "row_id int, patient_id string, recorded_at timestamp_ntz, has_recorded_at boolean")
    found = reasons(Q.check_vitals(raw, table(spark, "patients", [patient("A", BORN)])))
    assert found == {1: "Invalid recorded_at value", 2: None, 3: None}
    text = spark.createDataFrame([(1, "A", "2001-01-01 10:00:00"), (2, "A", "yesterday")],
                                 "row_id int, patient_id string, recorded_at string")
    found = reasons(Q.check_vitals(text, table(spark, "patients", [patient("A", BORN)])))
    assert found == {1: None, 2: "Invalid recorded_at value"}


def test_unchecked_readings_must_fit_the_table(spark):
    raw = spark.createDataFrame(
        [(1, "A", "16", "98.5"), (2, "A", "x", "98.5"), (3, "A", None, "9999.9"),
         (4, "A", "900", "0")],
        "row_id int, patient_id string, respiratory_rate string, oxygen_saturation string")
    found = reasons(Q.check_vitals(raw, table(spark, "patients", [patient("A", BORN)])))
    assert found == {1: None, 2: "Invalid respiratory_rate value",
                     3: "Invalid oxygen_saturation value", 4: None}


def test_accepted_and_rejected_are_all(spark):
    t = HospitalTables(spark, "/root/testdata/sf0.001")
    good, bad = Q.validate_vitals(t["raw_vitals"], t["patients"])
    assert (good.count(), bad.count()) == (761, 739)
    assert Q.REASON not in good.columns
    good, bad = Q.validate_patients(t["raw_patients"])
    assert good.count() + bad.count() == 150


@pytest.mark.parametrize("text, fine", [
    ("1990-02-28", True), ("1990-2-3", True), ("2000-02-29", True), ("1990-02-30", False),
    ("1990", False), ("1990-13-01", False), ("01/02/1990", False), ("", False),
    ("90-01-01", False), ("0000-01-01", False), ("1990-01-01x", False), ("1990-01-01 ", False)])
def test_calendar_dates(spark, text, fine):
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(Q.is_calendar_date(F.col("d"))).first()[0] is fine


def test_patient_checks(spark):
    long = "x" * 101
    rows = [(1, "A", "B", "1990-01-01", None), (2, None, "B", "1990-01-01", None),
            (3, "A", None, None, None), (4, "A", "B", None, None), (5, long, long, "x", None),
            (6, "A", long, "x", None), (7, "A", "B", "x", long), (8, "", "B", "1990-01-01", None),
            (9, "A" * 100, "B", "1990-01-01", long)]
    raw = spark.createDataFrame(rows, "row_id int, first_name string, last_name string, "
                                      "date_of_birth string, email string")
    found = reasons(Q.check_patients(raw))
    assert found == {
        1: None, 2: "Missing required field: first_name", 3: "Missing required field: last_name",
        4: "Missing required field: date_of_birth", 5: "Invalid first_name",
        6: "Invalid last_name", 7: "Invalid date_of_birth format", 8: None, 9: "Too long: email"}
    assert reasons(Q.check_patients(raw, form=True))[8] == "Missing required field: first_name"


def test_audit_finds_every_kind_of_fault(spark):
    t = hospital(
        spark,
        patients=[patient("A", BORN), patient("A", BORN), patient("B", None, gender="x" * 21)],
        vitals=[{"vital_id": 1, "patient_id": "nobody", "recorded_at": datetime(2001, 1, 1)},
                {"vital_id": 2, "patient_id": "nobody", "recorded_at": None,
                 "temperature": Decimal("36.60")},
                {"vital_id": None, "patient_id": "A", "recorded_at": None}],
        doctors=[{"doctor_id": 1, "first_name": "D", "last_name": "E"}],
        follow_up_visits=[{"visit_id": i, "patient_id": "A", "visit_date": BORN, "doctor_id": d}
                          for i, d in enumerate([1, 2, None])])
    found = {(r.table_name, r.rule, r.column_name): r.violations
             for r in Q.audit(t).collect() if r.violations}
    assert found == {
        ("patients", "unique", "patient_id"): 1, ("patients", "not_null", "date_of_birth"): 1,
        ("patients", "length", "gender"): 1, ("vitals", "not_null", "vital_id"): 1,
        ("vitals", "not_null", "recorded_at"): 2, ("vitals", "foreign_key", "patient_id"): 2,
        ("follow_up_visits", "foreign_key", "doctor_id"): 1}
