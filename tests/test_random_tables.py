"""Operators against their SQL on random tables: orphans, ties, NULLs, a hot patient."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import duckdb
import pytest

from helpers import TODAY, table
from oracle_check import difference
from wardflow.operators import features, reports
from wardflow.plans.oracles import oracles

HOT = {"hot_rows": 30}
OPERATORS = {
    "high_risk": lambda t: reports.high_risk(t, TODAY, **HOT),
    "missed_follow_ups": lambda t: reports.missed_follow_ups(t, TODAY, **HOT),
    "abnormal_vitals": reports.abnormal_vitals,
    "delivery_methods": reports.delivery_methods,
    "demographics": lambda t: reports.demographics(t, TODAY),
    "age_distribution": lambda t: reports.age_distribution(t, TODAY),
    "dashboard_totals": lambda t: reports.dashboard_totals(t, TODAY),
    "recent_vitals": reports.recent_vitals,
    "risk_features": lambda t: features.risk_features(t, TODAY, **HOT),
    "risk_features_serving": lambda t: features.risk_features_serving(t, TODAY),
    "followup_features": lambda t: features.followup_features(t, TODAY, **HOT),
    "followup_features_serving": lambda t: features.followup_features_serving(t, TODAY),
    "vitals_lag_features": lambda t: features.vitals_lag_features(t),
    "vitals_features_serving": lambda t: features.vitals_features_serving(t, TODAY),
    "filter_recent_delivery": lambda t: reports.filter_patients(t, "recent", TODAY, 365),
    "monthly_visits": reports.monthly_visits,
}


def random_rows(seed: int) -> dict[str, list[dict]]:
    r = random.Random(seed)
    people = [f"P{i:02}" for i in range(40)]

    def who():
        """A third of the rows belong to one patient, a few to no patient."""
        return r.choice(["P00"] * 3 + [r.choice([*people, "nobody"])] * 6)

    def day(low, high):
        return low + timedelta(days=r.randrange((high - low).days + 1))

    def reading(values):
        return r.choice([None, *values])

    patients = [{
        "patient_id": p, "first_name": r.choice(["Ann", "BOB"]), "last_name": p,
        "date_of_birth": r.choice([date(1966, 1, 1), date(1966, 1, 2), date(1984, 1, 1),
                                   date(1972, 2, 29), day(date(1930, 1, 1), date(2001, 12, 31))]),
        "gender": r.choice(["Female", "FEMALE", "female", "Male", "", None]),
        "email": r.choice([None, "", "a@b"]), "phone": r.choice([None, "", "1"]),
        "city": r.choice([None, "", "Oslo", "OSLO", "Rome"]), "state": r.choice([None, "N", "n"]),
        "insurance_provider": r.choice([None, "", "X"])} for p in people]
    vitals = [{
        "vital_id": i, "patient_id": who(),
        "recorded_at": datetime(2001, 1, 1) + timedelta(minutes=30 * r.randrange(40)),
        "temperature": reading([Decimal("37.50"), Decimal("37.51"), Decimal("0.00")]),
        "heart_rate": reading([0, 100, 101]), "blood_pressure_systolic": reading([0, 140, 141]),
        "blood_pressure_diastolic": reading([90, 91]), "respiratory_rate": reading([0, 16]),
        "oxygen_saturation": reading([Decimal("95.00"), Decimal("94.99")])} for i in range(300)]
    history = [{
        "history_id": i, "patient_id": who(), "diagnosis_date": None,
        "condition_name": r.choice(["Asthma", "ASTHMA", "mild Hypertension", "diabetes ii", "Flu",
                                    "hypertension with diabetes"])} for i in range(60)]
    deliveries = [{
        "delivery_id": i, "patient_id": who(),
        "delivery_date": r.choice([None, day(date(2000, 6, 1), date(2002, 2, 1))]),
        "delivery_method": r.choice([None, "Vaginal", "VAGINAL", "c-section", "Other"]),
        "complications": r.choice([None, "", "Fever"]),
        "birth_weight": reading([Decimal("2.50"), Decimal("3.33")]),
        "attending_doctor": r.choice([None, "Dr X", "dr x", "Dr Y"])} for i in range(60)]
    visits = [{
        "visit_id": i, "patient_id": who(), "visit_date": day(date(2001, 10, 1), date(2002, 1, 5)),
        "follow_up_required": r.choice([None, True, True, False]),
        "follow_up_date": r.choice([None, TODAY, day(date(2001, 12, 1), date(2002, 1, 5))])}
        for i in range(150)]
    return {"patients": patients, "vitals": vitals, "medical_history": history,
            "delivery_information": deliveries, "follow_up_visits": visits}


@pytest.fixture(scope="module", params=[1, 2])
def both(request, spark, tmp_path_factory):
    """The same random tables in Spark and in DuckDB."""
    root, con = tmp_path_factory.mktemp("random"), duckdb.connect()
    tables = {}
    for name, rows in random_rows(request.param).items():
        df = table(spark, name, rows)
        df = df.withColumns({f.name: df[f.name].cast("timestamp_ntz") for f in df.schema
                             if f.dataType.typeName() == "timestamp"})
        df.write.parquet(f"{root}/{name}")
        tables[name] = spark.read.parquet(f"{root}/{name}")
        con.execute(f"CREATE VIEW {name} AS FROM read_parquet('{root}/{name}/*.parquet')")
    return tables, con


@pytest.mark.parametrize("name", OPERATORS)
def test_same_rows(both, name):
    tables, con = both
    rows, found = difference(OPERATORS[name](tables), con, oracles(derived=False)[name])
    assert not found
    assert rows
