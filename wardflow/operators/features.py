"""Feature tables for the three models, and the helpers that prepare them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from itertools import count, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.functions import exprs as E
from wardflow.functions import scan, skew
from wardflow.operators.reports import last_visit_per_patient, missed_condition
from wardflow.session import settle

Tables = Mapping[str, DataFrame]

READINGS = ["temperature", "heart_rate", "blood_pressure_systolic",
            "blood_pressure_diastolic", "respiratory_rate", "oxygen_saturation"]

# The conditions looked for, and the names of the lagged readings.
CONDITIONS = {"has_hypertension": "hypertension", "has_diabetes": "diabetes",
              "has_asthma": "asthma"}
PREVIOUS = {"prev_temperature": "temperature", "prev_heart_rate": "heart_rate",
            "prev_bp_systolic": "blood_pressure_systolic",
            "prev_bp_diastolic": "blood_pressure_diastolic",
            "prev_respiratory_rate": "respiratory_rate",
            "prev_oxygen_saturation": "oxygen_saturation"}
# A vitals row without one of these previous readings is not used.
NEEDED_PREVIOUS = ["prev_temperature", "prev_heart_rate", "prev_bp_systolic",
                   "prev_bp_diastolic"]
UNKNOWN = "Unknown"


# -- pregnancy risk -----------------------------------------------------------

def _condition_flags() -> dict[str, str]:
    """SQL text of each flag of a condition, 0 or 1."""
    return {flag: f"int(coalesce(contains(lower(condition_name), '{word}'), false))"
            for flag, word in CONDITIONS.items()}


def _vitals(t: Tables) -> DataFrame:
    return t["vitals"].select("patient_id", "vital_id", "recorded_at", *READINGS)


def _latest_reading(t: Tables) -> DataFrame:
    return (skew.first_per_key(_vitals(t), ["patient_id"],
                               [F.desc("recorded_at"), F.desc("vital_id")])
            .drop("vital_id", "recorded_at"))


# The combinations of the condition flags; the first is that of no condition.
_KINDS = list(product((0, 1), repeat=len(CONDITIONS)))


def _counts_by_kind(history: DataFrame) -> DataFrame:
    """Per patient, the number of conditions of each combination of flags."""
    flags = _condition_flags().values()
    weights = [2 ** place for place in reversed(range(len(CONDITIONS)))]
    number = " + ".join(f"{w} * {flag}" for w, flag in zip(weights, flags, strict=True))
    return (history.selectExpr("patient_id", f"{number} AS _kind").groupBy("patient_id")
            .agg(*[F.expr(f"count_if(_kind = {i})").alias(f"_kind_{i}")
                   for i in range(len(_KINDS))]))


def _occurring(names: list[str], kinds: list[tuple[int, ...]], prefix: str, count: str) -> Column:
    """The kinds with a count as an array; the first one, once, if nothing was counted."""
    structs = []
    for i, values in enumerate(kinds):
        fields = ", ".join(f"'{n}', {v}" for n, v in zip(names, values, strict=True))
        counted = f"{prefix}{i}" if i else f"coalesce({prefix}{i}, 1L)"
        structs.append(f"named_struct({fields}, '{count}', {counted})")
    return F.expr(f"filter(array({', '.join(structs)}), kind -> kind.{count} > 0)")


def risk_features(t: Tables, as_of: date | None = None,
                  hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Training rows of the pregnancy-risk model, women only.

    A training row is one combination of latest reading, condition and
    delivery. Equal rows are kept as one with their number in ``copies``: only
    three flags and one yes/no of a condition or delivery matter, so a patient
    has at most 16 different rows per reading however long the history.
    The label is a function of the features and of past complications.
    """
    women = (t["patients"].filter(E.same_text(F.col("gender"), "Female"))
             .select("patient_id",
                     E.age_years(as_of).alias("age")))
    timed = _vitals(t).filter("recorded_at IS NOT NULL")
    latest = (skew.latest_with_ties(timed, ["patient_id"], "recorded_at", ["vital_id"],
                                    hot_rows).whole()
              .groupBy("patient_id", *READINGS).agg(F.count(F.lit(1)).alias("_readings")))
    deliveries = t["delivery_information"].groupBy("patient_id").agg(
        F.expr("count_if(coalesce(complications, '') = '')").alias("_outcome_0"),
        F.expr("count_if(complications <> '')").alias("_outcome_1"))
    # Every join is by patient alone, so the sides meet without another shuffle.
    rows = (women.join(latest, "patient_id", "left")
            .join(_counts_by_kind(t["medical_history"]), "patient_id", "left")
            .join(deliveries, "patient_id", "left")
            .select("patient_id", "age", *READINGS, "_readings",
                    _occurring(["had_complications"], [(0,), (1,)], "_outcome_", "_deliveries")
                    .alias("_outcomes"),
                    F.inline(_occurring(list(CONDITIONS), _KINDS, "_kind_", "_conditions")))
            .select("*", F.inline("_outcomes")))
    high_risk = ((F.col("age") > E.RISK_AGE) | E.high_pressure()
                 | (F.col("had_complications") == 1) | (F.col("has_hypertension") == 1)
                 | (F.col("has_diabetes") == 1))
    copies = F.coalesce("_readings", F.lit(1)) * F.col("_conditions") * F.col("_deliveries")
    return rows.select("patient_id", "age", *READINGS, *CONDITIONS, "had_complications",
                       E.flag(high_risk).alias("high_risk"), copies.alias("copies"))


def risk_features_serving(t: Tables, as_of: date | None = None) -> DataFrame:
    """The same features for scoring, one row per patient.

    The reading is the latest one; a condition counts if any entry names it.
    """
    held = t["medical_history"].groupBy("patient_id").agg(*[
        F.expr(f"max({flag})").alias(name) for name, flag in _condition_flags().items()])
    return (t["patients"]
            .select("patient_id", E.age_years(as_of).alias("age"))
            .join(_latest_reading(t), "patient_id", "left")
            .join(held, "patient_id", "left")
            .na.fill(0, list(CONDITIONS))
            .select("patient_id", "age", *READINGS, *CONDITIONS))


# -- missed follow-ups --------------------------------------------------------

def _contact_features(t: Tables, as_of: date | None) -> DataFrame:
    return t["patients"].select(
        "patient_id", E.age_years(as_of).alias("age"), "gender",
        E.flag(E.has_text(F.col("city"))).alias("has_address"),
        E.flag(E.has_text(F.col("phone"))).alias("has_phone"),
        E.flag(E.has_text(F.col("email"))).alias("has_email"),
        E.flag(E.has_text(F.col("insurance_provider"))).alias("has_insurance"))


FOLLOWUP_NUMBERS = ["age", "has_address", "has_phone", "has_email", "has_insurance",
                    "days_between_visits"]


def followup_features(t: Tables, as_of: date | None = None,
                      hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """One training row per follow-up visit, labelled if it was missed."""
    patients = _contact_features(t, as_of).na.fill(UNKNOWN, ["gender"]).join(
        last_visit_per_patient(t), "patient_id")
    visits = t["follow_up_visits"].select("patient_id", "visit_id", "visit_date",
                                          "follow_up_required", "follow_up_date")
    split = skew.split_hot(visits, ["patient_id"], ["visit_id"], hot_rows)
    return split.join(patients, "patient_id").select(
        "patient_id", "visit_id", "age", "gender", "has_address", "has_phone", "has_email",
        "has_insurance", F.datediff("follow_up_date", "visit_date").alias("days_between_visits"),
        E.flag(missed_condition(as_of)).alias("missed_followup"))


def followup_features_serving(t: Tables, as_of: date | None = None) -> DataFrame:
    """The same features from each patient's latest visit, if there is one."""
    latest = skew.first_per_key(
        t["follow_up_visits"].select("patient_id", "visit_id", "visit_date", "follow_up_date"),
        ["patient_id"], [F.desc("visit_date"), F.desc("visit_id")])
    return (_contact_features(t, as_of).join(latest, "patient_id", "left")
            .select("patient_id", "age", "gender", "has_address", "has_phone", "has_email",
                    "has_insurance",
                    F.datediff("follow_up_date", "visit_date").alias("days_between_visits")))


# -- future vitals ------------------------------------------------------------

def vitals_lag_features(t: Tables) -> DataFrame:
    """Each reading with the patient's previous one; target is the systolic pressure.

    Age is the age at the reading. Rows whose target is missing are kept.
    """
    patients = t["patients"].select("patient_id", "date_of_birth",
                                    F.coalesce("gender", F.lit(UNKNOWN)).alias("gender"))
    age = E.years_between("date_of_birth", "recorded_at")
    return (scan.lagged(_vitals(t), ["patient_id"], ["recorded_at", "vital_id"], PREVIOUS)
            .dropna(subset=NEEDED_PREVIOUS)
            .join(patients, "patient_id")
            .select("patient_id", "vital_id", "recorded_at", "gender",
                    age.alias("age_at_recording"), *PREVIOUS, "blood_pressure_systolic"))


def vitals_features_serving(t: Tables, as_of: date | None = None) -> DataFrame:
    """Each patient's latest reading as the previous one, with the age today."""
    latest = _latest_reading(t).select(
        "patient_id", *[F.col(old).alias(new) for new, old in PREVIOUS.items()])
    return (t["patients"]
            .select("patient_id",
                    E.age_years(as_of).alias("age_at_recording"))
            .join(latest, "patient_id"))


# -- preparation --------------------------------------------------------------

# Bins of a pass of the selection by rank.
BINS = 1024


def _finite(value: Column) -> Column:
    largest = float(np.finfo(float).max)
    return F.when(value.isNull() | F.isnan(value), value).otherwise(
        F.greatest(F.least(value, F.lit(largest)), F.lit(-largest)))


def _half(value: Column) -> Column:
    """So that the width of the widest range is finite."""
    return value / 2


def _magnitude(value: Column) -> Column:
    """A logarithm that grows with the value over all numbers, negative ones included."""
    return F.when(value == 0, 0.0).otherwise(F.signum(value) * (F.log(F.abs(value)) + 800))


def _ranks(total: int) -> tuple[int, int]:
    """Places, from 0, of the two middle values of that many (the same one if odd)."""
    return (total - 1) // 2, total // 2


def medians(df: DataFrame, columns: Sequence[str], copies: str | None = None) -> dict[str, float]:
    """Exact interpolated medians; ``copies`` counts how often a row stands.

    By selection: the values between two bounds are counted in ``BINS`` bins, the bin
    that holds the wanted rank gives the next bounds, until a bin has one value. Bins
    are of equal width in one pass and of equal width of the logarithm in the next, so
    neither a narrow range nor one of many magnitudes takes many passes. Each pass counts
    all columns at once and returns at most ``BINS`` rows for each, so no task or driver
    holds the distinct values. NULL and NaN do not count; infinity is the largest number.
    """
    weight = F.lit(1) if copies is None else F.col(copies).cast("bigint")
    rows = settle(df.select(weight.alias("_copies"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("column"), _finite(F.col(c).cast("double")).alias("value"))
        for i, c in enumerate(columns)])).alias("v"))
        .select("_copies", "v.*").filter("value IS NOT NULL AND NOT isnan(value)"), "median-values")
    # By column and wanted rank: bounds, and the rank among the values within them.
    wanted: dict[tuple[int, int], tuple[float, float, int]] = {}
    found: dict[tuple[int, int], float] = {}
    for row in rows.groupBy("column").agg(
            F.min("value").alias("low"), F.max("value").alias("high"),
            F.sum("_copies").alias("n")).collect():
        for which, rank in enumerate(_ranks(row["n"])):
            wanted[row["column"], which] = (row["low"], row["high"], rank)
    for turn in count():
        for key, (low, high, _) in list(wanted.items()):
            if low == high:
                found[key] = low
                del wanted[key]
        if not wanted:
            break
        ranges = df.sparkSession.createDataFrame(
            [(c, which, low, high) for (c, which), (low, high, _) in wanted.items()],
            "column int, which int, low double, high double")
        scale = _magnitude if turn % 2 else _half
        low, high = scale(F.col("low")), scale(F.col("high"))
        place = F.coalesce(F.try_divide(scale(F.col("value")) - low, high - low), F.lit(0.0)) * BINS
        bins = (rows.join(F.broadcast(ranges), "column").filter("value BETWEEN low AND high")
                .groupBy("column", "which", F.least(F.floor(place), F.lit(BINS - 1)).alias("bin"))
                .agg(F.min("value").alias("least"), F.max("value").alias("most"),
                     F.sum("_copies").alias("n")).orderBy("column", "which", "bin").collect())
        for key, (_, _, rank) in list(wanted.items()):
            for row in (r for r in bins if (r["column"], r["which"]) == key):
                if rank < row["n"]:
                    wanted[key] = (row["least"], row["most"], rank)
                    break
                rank -= row["n"]
    return {c: found[i, 0] / 2 + found[i, 1] / 2 if (i, 0) in found else None
            for i, c in enumerate(columns)}


def median_fill(df: DataFrame, columns: Sequence[str], copies: str | None = None) -> DataFrame:
    """Missing values of each column replaced by the column's median, as doubles."""
    found = medians(df, columns, copies)
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(found[c]).cast("double")) for c in columns})


# Bits of a draw, and of a digit that a pass of the stratified split counts by.
_DRAW_DIGITS, _DIGIT_BITS = 4, 12


def draw(keys: Sequence[str], seed: int = 42) -> Column:
    """A number of 48 bits from a hash of the keys: the same on every run."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit(""))
                                            for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def split(df: DataFrame, keys: Sequence[str], test_percent: int = 20,
          seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows by a hash of their keys.

    Needs no shuffle, gives the same split on every run, and takes the same
    share of each label on average.
    """
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit(""))
                                            for k in keys])
    drawn = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
    return df.filter(drawn >= test_percent), df.filter(drawn < test_percent)


def stratified_limits(df: DataFrame, keys: Sequence[str], label: str, test_percent: int = 20,
                      seed: int = 42) -> dict[object, int]:
    """For each label the draw below which its share of rows lies, exact to one row.

    Found digit by digit: a pass counts the rows by label and by the next twelve bits of
    their draw, among those that agree with the digits found so far. Nothing is sorted,
    and a pass returns at most 4,096 rows a label. Rows with the same keys draw the
    same number and stay together.
    """
    rows = settle(df.select(F.col(label).alias("label"), draw(keys, seed).alias("draw")), "draws")
    left = {r["label"]: (0, (2 * r["n"] * test_percent + 100) // 200)
            for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    for place in reversed(range(_DRAW_DIGITS)):
        shift = place * _DIGIT_BITS
        known = df.sparkSession.createDataFrame(
            [(k, prefix) for k, (prefix, _) in left.items()],
            T.StructType([T.StructField("_label", df.schema[label].dataType),
                          T.StructField("_prefix", T.LongType())]))
        near = rows.join(F.broadcast(known), F.col("label").eqNullSafe(F.col("_label"))
                         & (F.shiftright("draw", shift + _DIGIT_BITS) == F.col("_prefix")))
        digit = F.shiftright("draw", shift).bitwiseAND(F.lit((1 << _DIGIT_BITS) - 1))
        counts: dict[object, list] = {}
        for r in (near.groupBy("label", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
                  .orderBy("label", "digit").collect()):
            counts.setdefault(r["label"], []).append((r["digit"], r["n"]))
        for key, (prefix, rest) in left.items():
            # The digit in which the share ends; all of it is taken if it ends beyond.
            digits = counts.get(key, [])
            at = 0
            for at, n in digits:
                if n > rest:
                    break
                rest -= n
            else:
                at = at + 1 if digits else 0
            left[key] = ((prefix << _DIGIT_BITS) + at, rest)
    return {key: limit for key, (limit, _) in left.items()}


def stratified_split(df: DataFrame, keys: Sequence[str], label: str, test_percent: int = 20,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows; the test rows are the wanted share of each label."""
    limits = stratified_limits(df, keys, label, test_percent, seed)
    limit = F.lit(0).cast("bigint")  # two labels, a few at most
    for key, at in limits.items():
        limit = F.when(F.col(label).eqNullSafe(F.lit(key)), F.lit(at)).otherwise(limit)
    return df.filter(draw(keys, seed) >= limit), df.filter(draw(keys, seed) < limit)
