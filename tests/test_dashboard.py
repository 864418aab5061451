"""The maintained dashboard equals the batch job after every batch."""

from datetime import date, datetime

from pyspark.sql import functions as F

from helpers import TODAY, hospital, patient
from wardflow.operators import reports
from wardflow.operators.dashboard import Dashboard


def _tables(spark, step):
    """The tables after a number of batches: rows are added, changed and deleted."""
    people = [patient(f"P{i}", date(1950 + i % 40, 1, 1), city="X") for i in range(60) if not (step == 3 and i < 5)]
    if step >= 2:
        people.append(patient("new", date(1999, 1, 1)))
    vitals = [{"vital_id": i, "patient_id": f"P{i % 50}", "recorded_at": datetime(2001, 1, 1 + i % 28),
               "blood_pressure_systolic": 120 + i % 40 + (30 if step >= 3 and i % 50 == 7 else 0)}
              for i in range(150 + 40 * step) if not (step >= 2 and i % 50 == 9)]
    deliveries = [{"delivery_id": i, "patient_id": f"P{i % 20}", "delivery_date": date(2002, 1, 1 + i % 3),
                   "complications": "x" if i % 3 == 0 else None} for i in range(30 + step)]
    visits = [{"visit_id": i, "patient_id": f"P{i % 30}", "visit_date": date(2001, 1, 1 + i % 20),
               "follow_up_required": True, "follow_up_date": date(2001, 2, 1)} for i in range(30 + 2 * step)]
    return hospital(spark, patients=people, vitals=vitals, delivery_information=deliveries,
                    follow_up_visits=visits,
                    medical_history=[{"history_id": i, "patient_id": f"P{i % 7}"} for i in range(10 + step)])


def _same(kept, t):
    assert kept.totals().collect() == reports.dashboard_totals(t, TODAY).collect()
    assert sorted(map(tuple, kept.age_distribution().collect())) == sorted(
        map(tuple, reports.age_distribution(t, TODAY).collect()))


def _touched(spark, before, after):
    """Patients whose rows differ in some table."""
    ids = set()
    for name in before:
        if "patient_id" in before[name].columns:
            ids |= {r.patient_id for a, b in ((before, after), (after, before))
                    for r in a[name].exceptAll(b[name]).select("patient_id").distinct().collect()}
    return spark.createDataFrame([(i,) for i in [*ids, None, "nobody"]], "patient_id string")


def test_batches_with_updates_and_deletes(spark, tmp_path):
    t = _tables(spark, 0)
    kept = Dashboard.create(t, TODAY, f"{tmp_path}/d", 16)
    _same(kept, t)
    for step in (1, 2, 3):
        after = _tables(spark, step)
        touched = _touched(spark, t, after)
        kept.refresh(after, touched)
        t = after
        _same(Dashboard.open(spark, f"{tmp_path}/d", TODAY), t)


def test_a_batch_of_one_patient_rewrites_one_bucket(spark, tmp_path):
    t = _tables(spark, 1)
    kept = Dashboard.create(t, TODAY, f"{tmp_path}/d", 16)
    before = set(kept._counts.rows().inputFiles())
    kept.refresh(t, spark.createDataFrame([("P3",)], "patient_id string"))
    after = set(kept._counts.rows().inputFiles())
    assert len(after - before) == 1 and len(before - after) == 1
    _same(kept, t)
    kept.refresh(t, t["patients"].select("patient_id").filter(F.lit(False)))
    assert set(kept._counts.rows().inputFiles()) == after


def test_without_patients(spark, tmp_path):
    kept = Dashboard.create(hospital(spark), TODAY, f"{tmp_path}/d", 4)
    assert kept.totals().first().total_patients == 0
    kept.refresh(_tables(spark, 0), _tables(spark, 0)["patients"])
    _same(kept, _tables(spark, 0))




def test_touched_patients_are_made_distinct_once(spark, tmp_path):
    t = _tables(spark, 1)
    kept = Dashboard.create(t, TODAY, f"{tmp_path}/d", 4)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    touched = spark.createDataFrame([(f"P{i % 9}",) for i in range(200)], "patient_id string")
    kept.refresh(t, touched.mapInArrow(counted, "patient_id string"))
    assert read.value == 200
    _same(kept, t)
