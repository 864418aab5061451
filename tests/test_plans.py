"""What the plans must and must not contain, on tables written in the declared schema."""

import re
from datetime import datetime

import pytest

from helpers import TODAY
from wardflow.operators import features, profile, quality, reports
from wardflow.plans.queries import AUDITED
from wardflow.sources.derived import HospitalTables
from wardflow.sources.schemas import TABLES
from wardflow.sources.tables import read_tables, write_table


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    derived = HospitalTables(spark, "/root/testdata/sf0.001")
    for name in AUDITED:
        write_table(derived[name], root, name)
    return read_tables(spark, root, AUDITED)


@pytest.fixture(scope="module", autouse=True)
def large_tables(spark):
    """Plans as for tables too large to broadcast, written out in full."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.maxMetadataStringLength": "10000",
                "spark.sql.debug.maxToStringFields": "1000"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


OPERATORS = {
    "high_risk": lambda t: reports.high_risk(t, TODAY),
    "missed_follow_ups": lambda t: reports.missed_follow_ups(t, TODAY),
    "abnormal_vitals": reports.abnormal_vitals,
    "delivery_methods": reports.delivery_methods,
    "demographics": lambda t: reports.demographics(t, TODAY),
    "age_distribution": lambda t: reports.age_distribution(t, TODAY),
    "dashboard_totals": lambda t: reports.dashboard_totals(t, TODAY),
    "patient_profile": profile.patient_profile,
    "recent_vitals": reports.recent_vitals,
    "appointment_split": lambda t: reports.appointment_split(t, datetime(2000, 1, 1)),
    "deliveries_by_patient": reports.deliveries_by_patient,
    "risk_features": lambda t: features.risk_features(t, TODAY),
    "followup_features": lambda t: features.followup_features(t, TODAY),
    "vitals_lag_features": features.vitals_lag_features,
    "check_vitals": lambda t: quality.check_vitals(t["vitals"], t["patients"]),
    "audit": quality.audit,
}


def plan(df, run=True) -> str:
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def scanned(text: str, key: str) -> list[set[str]]:
    """Columns read by each scan of the table with the given key or column."""
    schemas = re.findall(r"ReadSchema: struct<(.*?)>\n", text + "\n")
    columns = [{c.split(":")[0] for c in re.split(r",(?=\w+:)", s)} for s in schemas]
    return [c for c in columns if key in c]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_python_and_no_pairing_of_all_rows(written, name):
    text = plan(OPERATORS[name](written))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in text


@pytest.mark.parametrize("name", OPERATORS)
def test_only_lists_of_bounded_size_are_broadcast(written, name):
    """No hot key here, so nothing is left to broadcast."""
    assert "BroadcastHashJoin" not in plan(OPERATORS[name](written))


def test_reports_read_only_their_columns(written):
    text = plan(OPERATORS["abnormal_vitals"](written))
    assert scanned(text, "heart_rate") == [
        {"vital_id", "patient_id", "temperature", "heart_rate", "blood_pressure_systolic",
         "blood_pressure_diastolic", "oxygen_saturation"}]
    assert scanned(text, "first_name") == [{"patient_id", "first_name", "last_name"}]
    text = plan(OPERATORS["age_distribution"](written))
    assert scanned(text, "date_of_birth") == [{"patient_id", "date_of_birth"}]


def test_filters_reach_the_scan(written):
    text = plan(OPERATORS["missed_follow_ups"](written))
    assert "EqualTo(follow_up_required,true)" in text
    assert "LessThan(follow_up_date,2002-01-01)" in text
    text = plan(profile.profile_entries(written, "P00000001"))
    assert text.count("EqualTo(patient_id,P00000001)") == text.count("ReadSchema")
    text = plan(reports.patient(written, "P00000001"))
    assert "EqualTo(patient_id,P00000001)" in text and "Exchange" not in text


def test_latest_rows_are_cut_before_the_shuffle(written):
    for name in ("recent_vitals", "high_risk", "risk_features"):
        text = plan(OPERATORS[name](written))
        before_shuffle = text.index("Partial", text.index("WindowGroupLimit"))
        assert "Exchange hashpartitioning(patient_id" in text[:before_shuffle]


def exchanges(text: str) -> int:
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range)partitioning", text))


def test_numbers_of_shuffles(written):
    """Without hot patients: one shuffle per table, and one for the final order.

    Profiles and lagged vitals start from rows dealt by range and written.
    """
    found = {n: exchanges(plan(OPERATORS[n](written))) for n in (
        "recent_vitals", "patient_profile", "vitals_lag_features", "risk_features",
        "followup_features", "missed_follow_ups", "abnormal_vitals", "check_vitals")}
    assert found == {
        "recent_vitals": 1,
        "patient_profile": 4,        # parts of lists; pages; pages by patient; patients
        "vitals_lag_features": 3,    # parts of patients; vitals; patients
        "risk_features": 4,          # patients; latest readings; history; deliveries
        "followup_features": 3,      # visits; last visits; patients
        "missed_follow_ups": 4,      # as above, and the order
        "abnormal_vitals": 3,        # vitals; patients; the order
        "check_vitals": 2,           # vitals; patients
    }


def test_declared_schemas_hold_their_keys():
    for table in TABLES.values():
        names = set(table.schema.names)
        assert {table.key, *table.required, *table.lengths, *table.references} <= names
        for parent, key in table.references.values():
            assert key == TABLES[parent].key
