"""The reports: risk, follow-up, vitals, delivery, demographic and list views.

Every function takes the hospital tables as a mapping of name to DataFrame.
``as_of`` is the reference date; None means the current date. ``ordered=False``
leaves out the final sort of a report, which on a large result costs a second
evaluation to sample its range partitions.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.functions import exprs as E
from wardflow.functions import scan, skew

Tables = Mapping[str, DataFrame]

_UNAVAILABLE = "N/A"


# -- high-risk patients -------------------------------------------------------

def _high_risk_rows(t: Tables, as_of: date | None, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    patients = t["patients"].select(
        "patient_id", E.full_name().alias("patient_name"), "date_of_birth",
        E.age_years(as_of).alias("age"))
    vitals = t["vitals"].select("patient_id", "vital_id", "recorded_at",
                                "blood_pressure_systolic", "blood_pressure_diastolic")
    vitals = vitals.filter("recorded_at IS NOT NULL")
    readings = (skew.latest_with_ties(vitals, ["patient_id"], "recorded_at", ["vital_id"], hot_rows)
                .outer(patients, "patient_id")
                .withColumn("_by_age", F.coalesce(F.col("age") > E.RISK_AGE, F.lit(False)))
                .withColumn("_by_pressure", E.high_pressure()))
    deliveries = t["delivery_information"].select("patient_id", "delivery_id", "complications")
    rows = (skew.split_hot(deliveries, ["patient_id"], ["delivery_id"], hot_rows)
            .outer(readings, "patient_id", unique=False)
            .filter(F.col("_by_age") | F.col("_by_pressure")
                    | E.has_text(F.col("complications"))))
    category = (F.when(F.col("_by_age"), E.AGE_RISK)
                .when(F.col("_by_pressure"), E.HYPERTENSION_RISK)
                .otherwise(E.PREVIOUS_COMPLICATIONS))
    rank = (F.when(F.col("_by_age") & F.col("_by_pressure"), 1)
            .when(F.col("_by_pressure"), 2)
            .when(F.col("_by_age"), 3)
            .otherwise(4))
    return rows.withColumns({"risk_category": category, "risk_rank": rank})


def high_risk(t: Tables, as_of: date | None = None, ordered: bool = True,
              hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Patients at risk by age, latest blood pressure or past complications.

    One row per latest reading and delivery of the patient. ``risk_category``
    names the first reason (age before pressure); ``risk_rank`` puts age with
    pressure first, then pressure, then age, and orders the result.
    """
    rows = _high_risk_rows(t, as_of, hot_rows)
    if ordered:
        # The ids spread the four ranks evenly over the sorted partitions.
        rows = rows.orderBy("risk_rank", "patient_id", "vital_id", "delivery_id")
    return rows.select("patient_id", "patient_name", "date_of_birth", "age",
                       "blood_pressure_systolic", "blood_pressure_diastolic",
                       "complications", "risk_category", "risk_rank")


# -- missed follow-ups --------------------------------------------------------

def last_visit_per_patient(t: Tables) -> DataFrame:
    return (t["follow_up_visits"].groupBy("patient_id")
            .agg(F.max("visit_date").alias("_last_visit")))


def missed_condition(as_of: date | None) -> Column:
    """Due before the reference date, and no visit after the due date.

    Needs the patient's last visit as ``_last_visit``: a visit later than the
    due date exists exactly if the last one is later. A visit on the due date
    does not count.
    """
    return (F.col("follow_up_required")
            & (F.col("follow_up_date") < E.today(as_of))
            & (F.col("_last_visit") <= F.col("follow_up_date")))


def _missed_rows(t: Tables, as_of: date | None, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    due = (t["follow_up_visits"]
           .filter(F.col("follow_up_required") & (F.col("follow_up_date") < E.today(as_of)))
           .select("patient_id", "visit_id", "visit_date", "follow_up_required",
                   "follow_up_date"))
    patients = (t["patients"]
                .select("patient_id", E.full_name().alias("patient_name"), "phone", "email")
                .join(last_visit_per_patient(t), "patient_id"))
    return (skew.split_hot(due, ["patient_id"], ["visit_id"], hot_rows)
            .join(patients, "patient_id").filter(missed_condition(as_of))
            .withColumn("days_overdue", F.datediff(E.today(as_of), "follow_up_date")))


def missed_follow_ups(t: Tables, as_of: date | None = None, ordered: bool = True,
                      hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Required follow-ups that were due and never kept, longest overdue first."""
    rows = _missed_rows(t, as_of, hot_rows)
    if ordered:
        rows = rows.orderBy(F.desc("days_overdue"), "patient_id", "visit_id")
    return rows.select("patient_id", "patient_name", "phone", "email",
                       F.col("visit_date").alias("last_visit_date"),
                       F.col("follow_up_date").alias("scheduled_follow_up"), "days_overdue")


# -- abnormal vitals ----------------------------------------------------------

def abnormal_counts() -> dict[str, Column]:
    """How many of a patient's readings lie outside each limit."""
    limits = {
        "high_temp_count": F.col("temperature") > E.HIGH_TEMPERATURE,
        "high_hr_count": F.col("heart_rate") > E.HIGH_HEART_RATE,
        "high_bp_systolic_count": F.col("blood_pressure_systolic") > E.HIGH_SYSTOLIC,
        "high_bp_diastolic_count": F.col("blood_pressure_diastolic") > E.HIGH_DIASTOLIC,
        "low_oxygen_count": F.col("oxygen_saturation") < E.LOW_OXYGEN,
    }
    return {name: F.count_if(outside) for name, outside in limits.items()}


def vitals_summary(vitals: DataFrame, min_count: int = 2) -> DataFrame:
    """Counts and means per patient, where some count reaches ``min_count``.

    Works on a stream as well: the counts and sums are all the state it needs.
    """
    counts = abnormal_counts()
    summary = vitals.groupBy("patient_id").agg(
        F.count("vital_id").alias("total_measurements"),
        E.exact_mean("temperature").alias("avg_temperature"),
        E.exact_mean("heart_rate").alias("avg_heart_rate"),
        E.exact_mean("blood_pressure_systolic").alias("avg_systolic"),
        E.exact_mean("blood_pressure_diastolic").alias("avg_diastolic"),
        E.exact_mean("oxygen_saturation").alias("avg_oxygen"),
        *[count.alias(name) for name, count in counts.items()])
    return summary.filter(F.greatest(*counts) >= min_count)


def abnormal_vitals(t: Tables, min_count: int = 2, ordered: bool = True) -> DataFrame:
    """Patients with repeated readings outside a limit, most such readings first."""
    names = t["patients"].select("patient_id", E.full_name().alias("patient_name"))
    rows = names.join(vitals_summary(t["vitals"], min_count), "patient_id")
    if not ordered:
        return rows
    total = sum((F.col(c) for c in abnormal_counts()), F.lit(0))
    return rows.orderBy(total.desc(), "patient_id")


# -- delivery methods ---------------------------------------------------------

# The counted delivery methods.
VAGINAL = "Vaginal"
C_SECTION = "C-section"


def delivery_methods(t: Tables) -> DataFrame:
    """Deliveries, methods and mean birth weight per attending doctor.

    Names that differ only in case are one doctor.
    """
    method = F.col("delivery_method")
    # First by the exact name, in a hash aggregation; the few results are then
    # merged by the folded name.
    by_name = (t["delivery_information"].groupBy("attending_doctor").agg(
        F.count(F.lit(1)).alias("total_deliveries"),
        F.count_if(E.same_text(method, VAGINAL)).alias("vaginal_deliveries"),
        F.count_if(E.same_text(method, C_SECTION)).alias("c_section_deliveries"),
        F.sum("birth_weight").alias("_weight"), F.count("birth_weight").alias("_weighed")))
    counts = ["total_deliveries", "vaginal_deliveries", "c_section_deliveries"]
    per_doctor = by_name.groupBy(F.lower("attending_doctor").alias("_doctor")).agg(
        F.min("attending_doctor").alias("attending_doctor"),
        *[F.sum(c).alias(c) for c in counts],
        F.try_divide(F.sum("_weight").cast("double"), F.sum("_weighed"))
        .alias("avg_birth_weight"))
    # Decimal arithmetic, so that a rate ending in 5 rounds up.
    rate = F.round(F.col("c_section_deliveries").cast("decimal(20,0)") * 100
                   / F.col("total_deliveries").cast("decimal(20,0)"), 2)
    return (per_doctor
            .orderBy(F.desc("total_deliveries"), "_doctor")
            .select("attending_doctor", *counts, rate.cast("double").alias("c_section_rate"),
                    "avg_birth_weight"))


# -- demographics -------------------------------------------------------------

def _patient_counts(t: Tables, as_of: date | None) -> DataFrame:
    """One row per patient: group, joined row count, deliveries of all time, of the
    month and with complications.

    ``patient_count`` counts rows of patient x condition x delivery. The
    product of two counts gives that number without forming the rows.
    """
    conditions = (t["medical_history"].groupBy("patient_id")
                  .agg(F.count(F.lit(1)).alias("_conditions")))
    this_month = F.trunc("delivery_date", "month") == F.trunc(E.today(as_of), "month")
    deliveries = (t["delivery_information"].groupBy("patient_id")
                  .agg(F.count("delivery_id").alias("_deliveries"),
                       F.count(F.lit(1)).alias("_all_deliveries"),
                       F.count_if(this_month).alias("_this_month"),
                       F.count_if(E.has_text(F.col("complications"))).alias("_complicated")))
    at_least_one = [F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
                    for c in ("_conditions", "_deliveries")]
    return (_patient_groups(t, as_of)
            .join(conditions, "patient_id", "left")
            .join(deliveries, "patient_id", "left")
            .withColumn("_rows", at_least_one[0] * at_least_one[1])
            .na.fill(0, ["_deliveries", "_all_deliveries", "_this_month", "_complicated"]))


def _patient_groups(t: Tables, as_of: date | None) -> DataFrame:
    return t["patients"].select(
        "patient_id", E.age_band(E.age_years(as_of)).alias("age_group"),
        "city", "state", (E.age_years(as_of) > E.RISK_AGE).alias("_by_age"))


def demographics(t: Tables, as_of: date | None = None) -> DataFrame:
    """Patients, conditions and deliveries by age band, city and state.

    ``patient_count`` repeats a patient per condition and delivery;
    ``distinct_patients`` does not. City, state and condition names that differ
    only in case are one.
    """
    counts = _patient_counts(t, as_of).select(
        "age_group", "city", "state", "_rows", "_deliveries", F.lit(1).alias("_patients"),
        F.lit(None).cast("string").alias("_condition"))
    held = (t["medical_history"]
            .select("patient_id", F.lower("condition_name").alias("_condition")).distinct()
            .join(_patient_groups(t, as_of), "patient_id")
            .select("age_group", "city", "state", F.lit(0).alias("_rows"),
                    F.lit(0).alias("_deliveries"), F.lit(0).alias("_patients"), "_condition"))
    sums = {"_rows": "patient_count", "_deliveries": "delivery_count",
            "_patients": "distinct_patients"}
    # First by the exact names, in a hash aggregation; the few results are then
    # merged by the folded names.
    by_name = (counts.unionByName(held)
               .groupBy("age_group", "city", "state", "_condition")
               .agg(*[F.sum(c).alias(c) for c in sums]))
    return (by_name
            .groupBy("age_group", F.lower("city").alias("_city"), F.lower("state").alias("_state"))
            .agg(F.min("city").alias("city"), F.min("state").alias("state"),
                 F.count_distinct("_condition").alias("unique_conditions"),
                 *[F.sum(c).alias(name) for c, name in sums.items()])
            .orderBy("_state", "_city", "age_group")
            .select("age_group", "city", "state", "patient_count", "unique_conditions",
                    "delivery_count", "distinct_patients"))


def age_distribution(t: Tables, as_of: date | None = None) -> DataFrame:
    """``patient_count`` of the demographics summed by age band."""
    return ages_of(_patient_counts(t, as_of))


def ages_of(counts: DataFrame) -> DataFrame:
    """The age distribution from the counts per patient."""
    return counts.groupBy("age_group").agg(F.sum("_rows").alias("patient_count"))


def _latest_reading_counts(t: Tables) -> DataFrame:
    """Per patient, the readings that share its latest time and those with high pressure."""
    by_time = (t["vitals"].filter("recorded_at IS NOT NULL").groupBy("patient_id", "recorded_at")
               .agg(F.count(F.lit(1)).alias("_n"), F.count_if(E.high_pressure()).alias("_high")))
    return by_time.groupBy("patient_id").agg(
        F.max_by("_n", "recorded_at").alias("_readings"),
        F.max_by("_high", "recorded_at").alias("_high_readings"))


def _missed_counts(t: Tables, as_of: date | None) -> DataFrame:
    """Per patient, the rows of the missed follow-ups.

    Visits are counted per due date first, so the window has a row per patient and day.
    """
    due = F.col("follow_up_required") & (F.col("follow_up_date") < E.today(as_of))
    by_date = (t["follow_up_visits"].groupBy("patient_id", "follow_up_date")
               .agg(F.count_if(due).alias("_due"), F.max("visit_date").alias("_last")))
    last = F.max("_last").over(Window.partitionBy("patient_id"))
    return (by_date.withColumn("_last_visit", last)
            .filter(F.col("_last_visit") <= F.col("follow_up_date"))
            .groupBy("patient_id").agg(F.sum("_due").alias("_missed")))


def dashboard_totals(t: Tables, as_of: date | None = None) -> DataFrame:
    """One row of totals over the other reports.

    ``deliveries`` are all deliveries; ``deliveries_this_month`` are those in
    the month of the reference date. The rows of the high-risk report are latest
    readings times deliveries; they are counted per patient and not formed, and
    every table is read once.
    """
    return totals_of(patient_partials(t, as_of))


def patient_partials(t: Tables, as_of: date | None = None) -> DataFrame:
    """One row per patient with the counts that the dashboard adds up.

    A patient's row depends on the patient's own rows alone.
    """
    return (_patient_counts(t, as_of)
            .join(_latest_reading_counts(t), "patient_id", "left")
            .join(_missed_counts(t, as_of), "patient_id", "left")
            .na.fill(0, ["_readings", "_high_readings", "_missed"])
            .select("patient_id", "age_group", "_by_age", "_rows", "_deliveries",
                    "_all_deliveries", "_this_month", "_complicated", "_readings",
                    "_high_readings", "_missed"))


def totals_of(counts: DataFrame) -> DataFrame:
    """The dashboard's row from the counts per patient."""
    # A patient without readings or deliveries has one row in their place.
    readings = F.greatest("_readings", F.lit(1))
    deliveries = F.greatest("_all_deliveries", F.lit(1))
    high_risk = (F.when(F.col("_by_age"), readings * deliveries)
                 .otherwise(F.col("_high_readings") * deliveries
                            + (readings - F.col("_high_readings")) * F.col("_complicated")))
    sums = {"total_patients": F.col("_rows"), "high_risk": high_risk,
            "missed_follow_ups": F.col("_missed"), "deliveries": F.col("_deliveries"),
            "deliveries_this_month": F.col("_this_month")}
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()])


# -- lists and per-patient views ----------------------------------------------

def patients(t: Tables) -> DataFrame:
    return t["patients"]


def patient(t: Tables, patient_id: str) -> DataFrame:
    """One patient by id; no row if there is none."""
    return t["patients"].filter(F.col("patient_id") == patient_id)


def contains_term(term: str) -> Column:
    """Whether name or date of birth contains the term, given in lower case."""
    return (F.lower(E.full_name()).contains(term)
            | F.date_format("date_of_birth", "yyyy-MM-dd").contains(term))


def search_patients(t: Tables, term: str) -> DataFrame:
    """Patients whose name, or date of birth as ISO text, contains the term.

    Reads all patients; ``operators.search`` has an index for repeated searches.
    """
    return t["patients"].filter(contains_term(term.lower()))


def _shown(column: str) -> Column:
    """Text of a number for display; missing and zero are not available."""
    value = F.col(column)
    return F.when(value != 0, value.cast("string")).otherwise(_UNAVAILABLE)


def recent_vitals(t: Tables, n: int = 5) -> DataFrame:
    """The last ``n`` readings per patient; position 1 is the latest."""
    readings = skew.first_per_key(
        t["vitals"].select("patient_id", "vital_id", "recorded_at", "temperature", "heart_rate",
                           "blood_pressure_systolic", "blood_pressure_diastolic",
                           "respiratory_rate", "oxygen_saturation"),
        ["patient_id"], [F.desc("recorded_at"), F.desc("vital_id")], n, position="position")
    both = (F.col("blood_pressure_systolic") != 0) & (F.col("blood_pressure_diastolic") != 0)
    pressure = F.when(both, F.concat_ws("/", "blood_pressure_systolic",
                                        "blood_pressure_diastolic")).otherwise(_UNAVAILABLE)
    return readings.select(
        "patient_id", "position", "vital_id", "recorded_at",
        _shown("temperature").alias("temperature"), _shown("heart_rate").alias("heart_rate"),
        pressure.alias("blood_pressure"), _shown("respiratory_rate").alias("respiratory_rate"),
        _shown("oxygen_saturation").alias("oxygen_saturation"))


def appointment_split(t: Tables, as_of_ts: datetime | None = None, past_n: int = 3) -> DataFrame:
    """Per patient all upcoming appointments, soonest first, and the last past ones."""
    now = E.now(as_of_ts)
    appointments = t["appointments"]
    when = F.col("appointment_date")
    upcoming = scan.numbered(
        appointments.filter(when >= now), ["patient_id"],
        [F.asc("appointment_date"), F.asc("appointment_id")], "position")
    past = skew.first_per_key(
        appointments.filter(when < now), ["patient_id"],
        [F.desc("appointment_date"), F.desc("appointment_id")], past_n, position="position")
    return (upcoming.withColumn("period", F.lit("upcoming"))
            .unionByName(past.withColumn("period", F.lit("past"))
                         .withColumn("position", F.col("position").cast("bigint"))))


def deliveries_by_patient(t: Tables) -> DataFrame:
    """Deliveries with their place in the patient's list, newest first."""
    return scan.numbered(t["delivery_information"], ["patient_id"],
                         [F.desc("delivery_date"), F.desc("delivery_id")], "position")


def with_overdue_band(df: DataFrame) -> DataFrame:
    """Severity of ``days_overdue``."""
    return df.withColumn("overdue_band", E.overdue_band(F.col("days_overdue")))


def with_risk_band(df: DataFrame) -> DataFrame:
    """Severity of ``risk_category``."""
    return df.withColumn("risk_band", E.risk_band(F.col("risk_category")))


# -- views the pages only hint at ---------------------------------------------
# Intent only: the pages show a chart of constants, a simulated filter and
# inert page links for these.

def monthly_visits(t: Tables) -> DataFrame:
    """Follow-up visits per calendar month."""
    return (t["follow_up_visits"]
            .groupBy(F.trunc("visit_date", "month").alias("month"))
            .agg(F.count(F.lit(1)).alias("visits")))


def filter_patients(t: Tables, kind: str, as_of: date | None = None,
                    recent_days: int = 30) -> DataFrame:
    """Patients at high risk, with a missed follow-up, or recently delivered."""
    if kind == "high-risk":
        chosen = _high_risk_rows(t, as_of)
    elif kind == "missed-followup":
        chosen = _missed_rows(t, as_of)
    elif kind == "recent":
        age = F.datediff(E.today(as_of), "delivery_date")
        chosen = t["delivery_information"].filter(age.between(0, recent_days))
    else:
        raise ValueError(f"unknown filter: {kind}")
    return t["patients"].join(chosen.select("patient_id").distinct(), "patient_id", "left_semi")


def page(df: DataFrame, key: str, size: int, after: object = None) -> DataFrame:
    """The next ``size`` rows by ``key``, after the last key already shown."""
    rest = df if after is None else df.filter(F.col(key) > after)
    return rest.orderBy(key).limit(size)
