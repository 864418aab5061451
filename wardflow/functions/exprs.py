"""Column expressions shared by the reports, features and quality checks."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, labels and limits of the clinical rules.
RISK_AGE = 35
HIGH_SYSTOLIC = 140
HIGH_DIASTOLIC = 90
HIGH_TEMPERATURE = 37.5
HIGH_HEART_RATE = 100
LOW_OXYGEN = 95
AGE_RISK = "Age Risk"
HYPERTENSION_RISK = "Hypertension Risk"
PREVIOUS_COMPLICATIONS = "Previous Complications"
AGE_BANDS = (("Under 18", 17), ("18-30", 30), ("31-45", 45), ("46-65", 65))
OLDEST_BAND = "Over 65"
OVERDUE_BANDS = ((30, "danger"), (14, "warning"))
OVERDUE_OTHERWISE = "info"
RISK_BAND = {AGE_RISK: "warning", HYPERTENSION_RISK: "danger",
             PREVIOUS_COMPLICATIONS: "danger"}
RISK_BAND_OTHERWISE = "success"


def today(as_of: date | None) -> Column:
    """The reference date as a column; the current date when none is given."""
    return F.expr(_today(as_of))


def _today(as_of: date | None) -> str:
    return "current_date()" if as_of is None else f"DATE '{as_of:%Y-%m-%d}'"


def now(as_of_ts: datetime | None) -> Column:
    """The reference time without a time zone; the current time when none is given."""
    if as_of_ts is None:
        return F.localtimestamp()
    return F.expr(f"TIMESTAMP_NTZ '{as_of_ts:%Y-%m-%d %H:%M:%S.%f}'")


def years_between(start: str, end: str) -> Column:
    """Completed years from one date to another, both given as SQL text.

    A birthday on 29 February completes its year on 1 March of a common year.
    Only calendar fields are used, so the session time zone has no effect on
    dates.
    """
    def day_number(d: str) -> str:
        return f"(year({d}) * 10000 + month({d}) * 100 + day({d}))"

    return F.expr(f"int(({day_number(end)} - {day_number(start)}) div 10000)")


def age_years(as_of: date | None) -> Column:
    """Age of the patient, from ``date_of_birth``, on the reference date."""
    return years_between("date_of_birth", _today(as_of))


def age_band(age: Column) -> Column:
    """Label of the age band; a missing age falls in the last band."""
    (label, upper), *others = AGE_BANDS
    band = F.when(age <= upper, label)
    for label, upper in others:
        band = band.when(age <= upper, label)
    return band.otherwise(OLDEST_BAND)


def same_text(column: Column, value: str) -> Column:
    """Equality that ignores case."""
    return F.lower(column) == value.lower()


def has_text(column: Column) -> Column:
    """True where the column is neither NULL nor empty; never NULL."""
    return F.coalesce(column != "", F.lit(False))


def flag(condition: Column) -> Column:
    """1 where the condition holds, otherwise 0 (also for NULL)."""
    return F.when(condition, 1).otherwise(0)


def full_name() -> Column:
    return F.concat("first_name", F.lit(" "), "last_name")


def high_pressure() -> Column:
    """Systolic or diastolic above its limit; never NULL."""
    return F.coalesce(
        (F.col("blood_pressure_systolic") > HIGH_SYSTOLIC)
        | (F.col("blood_pressure_diastolic") > HIGH_DIASTOLIC),
        F.lit(False))


def exact_mean(column: str) -> Column:
    """Mean of an integer or decimal column, as a double.

    The sum is exact, so the result does not depend on the order of the rows.
    """
    return F.try_divide(F.sum(column).cast("double"), F.count(column))


def overdue_band(days: Column) -> Column:
    band = F.lit(OVERDUE_OTHERWISE)
    for limit, label in reversed(OVERDUE_BANDS):
        band = F.when(days > limit, label).otherwise(band)
    return band


def risk_band(category: Column) -> Column:
    band = F.lit(RISK_BAND_OTHERWISE)
    for label, colour in RISK_BAND.items():
        band = F.when(category == label, colour).otherwise(band)
    return band
