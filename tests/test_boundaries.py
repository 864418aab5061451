"""Limits of the clinical rules, on written rows."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import TODAY, hospital, patient, table
from wardflow.functions import exprs as E
from wardflow.operators import features, reports

YOUNG = date(1975, 6, 1)


def reading(number, key, when=datetime(2001, 1, 1), **values):
    return {"vital_id": number, "patient_id": key, "recorded_at": when, **values}


def visit(number, key, day, due=None, required=True):
    return {"visit_id": number, "patient_id": key, "visit_date": day, "follow_up_date": due,
            "follow_up_required": required}


@pytest.mark.parametrize("born, day, years", [
    (date(2004, 2, 29), date(2005, 2, 28), 0),
    (date(2004, 2, 29), date(2005, 3, 1), 1),
    (date(2004, 2, 29), date(2008, 2, 29), 4),
    (date(1966, 1, 1), TODAY, 36),
    (date(1966, 1, 2), TODAY, 35),
    (date(2002, 12, 31), TODAY, 0),
])
def test_completed_years(spark, born, day, years):
    df = spark.createDataFrame([(born,)], "date_of_birth date")
    assert df.select(E.age_years(day)).first()[0] == years


def test_age_bands(spark):
    ages = [17, 18, 30, 31, 45, 46, 65, 66, None]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    assert [r[0] for r in df.select(E.age_band(F.col("age"))).collect()] == [
        "Under 18", "18-30", "18-30", "31-45", "31-45", "46-65", "46-65", "Over 65", "Over 65"]


def test_high_risk_limits(spark):
    t = hospital(
        spark,
        patients=[patient(k, YOUNG) for k in "ABCDEFGH"] + [
            patient("I", date(1966, 1, 1)), patient("J", date(1966, 1, 2))],
        vitals=[
            reading(1, "A", blood_pressure_systolic=140, blood_pressure_diastolic=90),
            reading(2, "B", blood_pressure_systolic=141, blood_pressure_diastolic=90),
            reading(3, "C", blood_pressure_systolic=None, blood_pressure_diastolic=91),
            # Only the latest reading counts.
            reading(4, "D", datetime(2000, 1, 1), blood_pressure_systolic=200),
            reading(5, "D", datetime(2001, 1, 1), blood_pressure_systolic=120),
            # Both latest readings count.
            reading(6, "E", blood_pressure_systolic=150),
            reading(7, "E", blood_pressure_systolic=100, blood_pressure_diastolic=95)],
        delivery_information=[
            {"delivery_id": 1, "patient_id": "F", "complications": ""},
            {"delivery_id": 2, "patient_id": "G", "complications": None},
            {"delivery_id": 3, "patient_id": "H", "complications": "Hemorrhage"},
            {"delivery_id": 4, "patient_id": "I", "complications": ""},
            {"delivery_id": 5, "patient_id": "I", "complications": "Fever"},
            {"delivery_id": 6, "patient_id": "nobody", "complications": "Fever"}])
    rows = reports.high_risk(t, TODAY).collect()
    found = [(r.patient_id, r.risk_category, r.risk_rank) for r in rows]
    assert found == [
        ("B", "Hypertension Risk", 2), ("C", "Hypertension Risk", 2),
        ("E", "Hypertension Risk", 2), ("E", "Hypertension Risk", 2),
        ("I", "Age Risk", 3), ("I", "Age Risk", 3), ("H", "Previous Complications", 4)]


def test_high_risk_order_and_label_disagree(spark):
    """Age gives the label, but pressure alone ranks before age alone."""
    old = date(1950, 1, 1)
    t = hospital(spark, patients=[patient("A", old), patient("B", old), patient("C", YOUNG)],
                 vitals=[reading(1, "B", blood_pressure_systolic=150),
                         reading(2, "C", blood_pressure_systolic=150)])
    rows = reports.high_risk(t, TODAY).collect()
    assert [(r.patient_id, r.risk_category, r.risk_rank) for r in rows] == [
        ("B", "Age Risk", 1), ("C", "Hypertension Risk", 2), ("A", "Age Risk", 3)]


def test_missed_follow_up_limits(spark):
    t = hospital(
        spark, patients=[patient(k, YOUNG) for k in "ABCDEF"],
        follow_up_visits=[
            visit(1, "A", date(2001, 1, 1), TODAY),                    # due today: not missed
            visit(2, "B", date(2001, 1, 1), date(2001, 12, 31)),       # due yesterday
            visit(3, "C", date(2001, 1, 1), date(2001, 6, 1)),
            visit(4, "C", date(2001, 6, 1), None),                     # on the day: still missed
            visit(5, "D", date(2001, 1, 1), date(2001, 6, 1)),
            visit(6, "D", date(2001, 6, 2), None),                     # later: kept
            visit(7, "E", date(2001, 1, 1), date(2001, 6, 1), None),   # not known if required
            visit(8, "F", date(2001, 1, 1), date(2001, 6, 1), False)])
    rows = reports.missed_follow_ups(t, TODAY).collect()
    assert [(r.patient_id, r.days_overdue) for r in rows] == [("C", 214), ("B", 1)]
    labels = {r.visit_id: r.missed_followup
              for r in features.followup_features(t, TODAY).collect()}
    assert {v for v, label in labels.items() if label} == {2, 3}
    assert len(labels) == 8


def test_abnormal_vitals_limits(spark):
    def pair(first, key, **values):
        return [reading(first, key, **values), reading(first + 1, key, **values)]

    t = hospital(
        spark, patients=[patient(k, YOUNG) for k in "ABCDEF"],
        vitals=[
            *pair(1, "A", temperature=Decimal("37.50"), oxygen_saturation=Decimal("95.00"),
                  heart_rate=100, blood_pressure_systolic=140, blood_pressure_diastolic=90),
            *pair(3, "B", temperature=Decimal("37.51")),
            *pair(5, "C", oxygen_saturation=Decimal("94.99")),
            reading(7, "D", heart_rate=101),            # once is not enough
            *pair(8, "E", heart_rate=101, blood_pressure_systolic=141)])
    rows = reports.abnormal_vitals(t).collect()
    assert [r.patient_id for r in rows] == ["E", "B", "C"]
    assert rows[0].total_measurements == 2
    assert rows[0].avg_temperature is None
    assert rows[1].avg_temperature == 37.51


def test_delivery_methods_folds_case_and_rounds_up(spark):
    def delivery(number, method, doctor):
        return {"delivery_id": number, "patient_id": "A", "delivery_method": method,
                "attending_doctor": doctor, "birth_weight": Decimal("3.10")}

    rows = [delivery(i, "VAGINAL", "Dr Lee") for i in range(15)]
    rows.append(delivery(15, "c-SECTION", "dr lee"))
    rows += [delivery(16, "C-section", None), delivery(17, "Assisted", None)]
    found = reports.delivery_methods(hospital(spark, delivery_information=rows)).collect()
    assert [(r.attending_doctor, r.total_deliveries, r.vaginal_deliveries,
             r.c_section_deliveries, r.c_section_rate) for r in found] == [
        ("Dr Lee", 16, 15, 1, 6.25), (None, 2, 0, 1, 50.0)]


def test_delivery_rate_rounds_half_up(spark):
    rows = [{"delivery_id": i, "patient_id": "A", "attending_doctor": "X",
             "delivery_method": "C-section" if i < 107 else "Vaginal"} for i in range(4000)]
    found = reports.delivery_methods(hospital(spark, delivery_information=rows)).first()
    assert found.c_section_rate == 2.68    # 2.675


def test_demographics_counts_joined_rows(spark):
    t = hospital(
        spark,
        patients=[patient("A", YOUNG, city="Oslo", state="N"),
                  patient("B", YOUNG, city="OSLO", state="n"), patient("C", YOUNG)],
        medical_history=[{"history_id": i, "patient_id": k, "condition_name": c}
                         for i, (k, c) in enumerate([("A", "Asthma"), ("A", "ASTHMA"),
                                                     ("A", "Flu"), ("B", "flu")])],
        delivery_information=[{"delivery_id": i, "patient_id": "A"} for i in range(2)])
    rows = [tuple(r) for r in reports.demographics(t, TODAY).collect()]
    assert rows == [("18-30", None, None, 1, 0, 0, 1), ("18-30", "OSLO", "N", 7, 2, 2, 2)]
    assert [tuple(r) for r in reports.age_distribution(t, TODAY).collect()] == [("18-30", 8)]


def test_overdue_and_risk_bands(spark):
    days = spark.createDataFrame([(31,), (30,), (15,), (14,)], "days_overdue int")
    assert [r.overdue_band for r in reports.with_overdue_band(days).collect()] == [
        "danger", "warning", "warning", "info"]
    kinds = spark.createDataFrame(
        [("Age Risk",), ("Hypertension Risk",), ("Previous Complications",), ("Normal",)],
        "risk_category string")
    assert [r.risk_band for r in reports.with_risk_band(kinds).collect()] == [
        "warning", "danger", "danger", "success"]


def test_recent_vitals_shows_what_is_missing(spark):
    t = hospital(spark, patients=[patient("A", YOUNG)], vitals=[
        reading(i, "A", datetime(2001, 1, i), blood_pressure_systolic=s,
                blood_pressure_diastolic=80, heart_rate=h)
        for i, (s, h) in enumerate([(120, 0), (0, 70), (None, None)], start=1)])
    rows = reports.recent_vitals(t, 2).orderBy("position").collect()
    assert [(r.vital_id, r.blood_pressure, r.heart_rate) for r in rows] == [
        (3, "N/A", "N/A"), (2, "N/A", "70")]


def test_appointments_now_is_upcoming(spark):
    now = datetime(2001, 6, 1, 12)
    days = [datetime(2001, m, 1, 12) for m in (2, 3, 4, 5, 6, 7)]
    t = hospital(spark, appointments=[
        {"appointment_id": i, "patient_id": "A", "appointment_date": d}
        for i, d in enumerate(days)])
    rows = reports.appointment_split(t, now).orderBy("period", "position").collect()
    assert [(r.period, r.position, r.appointment_id) for r in rows] == [
        ("past", 1, 3), ("past", 2, 2), ("past", 3, 1), ("upcoming", 1, 4), ("upcoming", 2, 5)]


def test_search_folds_case(spark):
    t = {"patients": table(spark, "patients", [patient("Quinn", YOUNG), patient("Lee", YOUNG)])}
    assert [r.last_name for r in reports.search_patients(t, "T QUI").collect()] == ["Quinn"]
    assert reports.search_patients(t, "1975-06").count() == 2


def test_report_properties(spark):
    from wardflow.sources.derived import HospitalTables
    t = HospitalTables(spark, "/root/testdata/sf0.001")
    totals = reports.dashboard_totals(t, TODAY).first()
    risk = reports.high_risk(t, TODAY)
    demographics = reports.demographics(t, TODAY)
    assert totals.high_risk == risk.count()
    assert totals.missed_follow_ups == reports.missed_follow_ups(t, TODAY).count()
    assert totals.total_patients == demographics.agg(F.sum("patient_count")).first()[0]
    assert demographics.agg(F.sum("distinct_patients")).first()[0] == t["patients"].count()
    assert risk.filter("risk_category = 'Normal'").count() == 0
    assert [r.risk_rank for r in risk.collect()] == sorted(r.risk_rank for r in risk.collect())
    assert (features.risk_features(t, TODAY).agg(F.sum("copies")).first()[0] == 198)


def test_pages_follow_each_other(spark):
    t = {"patients": table(spark, "patients", [patient(k, YOUNG) for k in "CABED"])}
    first = [r.patient_id for r in reports.page(t["patients"], "patient_id", 2).collect()]
    second = reports.page(t["patients"], "patient_id", 2, first[-1]).collect()
    assert first == ["A", "B"]
    assert [r.patient_id for r in second] == ["C", "D"]


def test_unknown_filter_is_refused(spark):
    with pytest.raises(ValueError):
        reports.filter_patients(hospital(spark), "other", TODAY)
