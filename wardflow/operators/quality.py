"""Checks of incoming records, and the audit of the declared constraints."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.sources.schemas import TABLES

Tables = Mapping[str, DataFrame]

REASON = "reject_reason"

# Accepted range of each checked reading, both ends included, and
# whether it is a whole number.
READING_RULES = {
    "temperature": ("Temperature", 30, 45, False),
    "heart_rate": ("Heart rate", 30, 220, True),
    "blood_pressure_systolic": ("Systolic blood pressure", 70, 250, True),
    "blood_pressure_diastolic": ("Diastolic blood pressure", 40, 150, True),
}
# Accepted written forms of numbers and dates.
WHOLE_NUMBER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
NOT_FINITE = r"^\s*[+-]?(nan|inf|infinity)\s*$"
CALENDAR_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
NAME_LENGTH = 100


def first_reason(checks: list[tuple[Column, str]]) -> Column:
    """Reason of the first check whose fault holds; NULL if none does."""
    return F.coalesce(*[F.when(fault, reason) for fault, reason in checks])


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col(REASON).isNull()).drop(REASON)


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col(REASON).isNotNull())


# -- vitals -------------------------------------------------------------------

def _reading_checks(column: str) -> list[tuple[Column, str]]:
    """Form, then range of a reading given as text or number; NULL passes.

    Not-a-number and infinity are numbers, but out of range.
    """
    label, low, high, whole = READING_RULES[column]
    text = F.col(column).cast("string")
    not_finite = F.lit(False) if whole else F.lower(text).rlike(NOT_FINITE)
    is_number = text.rlike(WHOLE_NUMBER if whole else NUMBER) | not_finite
    in_range = text.try_cast("double").between(low, high) & ~not_finite
    return [(~is_number, f"Invalid {label.lower()} value"),
            (~in_range, f"{label} out of range ({low}-{high})")]


def _storage_checks(columns: list[str]) -> list[tuple[Column, str]]:
    """Faults the table itself refuses: no time, or text that is no number."""
    types = {f.name: f.dataType for f in TABLES["vitals"].schema}
    checks = []
    if "recorded_at" in columns:
        missing = F.col("recorded_at").try_cast("timestamp_ntz").isNull()
        if "has_recorded_at" in columns:
            missing &= F.col("has_recorded_at")
        checks.append((missing, "Invalid recorded_at value"))
    for column in ("respiratory_rate", "oxygen_saturation"):
        if column in columns:
            value = F.col(column)
            checks.append((value.isNotNull() & value.try_cast(types[column]).isNull(),
                           f"Invalid {column} value"))
    return checks


def check_vitals(raw: DataFrame, patients: DataFrame) -> DataFrame:
    """Raw vitals with the reason of the first failed check, or NULL.

    The feed holds text as sent, so that "72.5" is refused as a heart rate. A
    ``recorded_at`` that is NULL was sent as NULL and is refused, unless
    a ``has_recorded_at`` column says the field was not sent. Stateless, so the
    feed may be a stream.
    """
    known = patients.select("patient_id", F.lit(True).alias("_known"))
    checks = [check for column in READING_RULES if column in raw.columns
              for check in _reading_checks(column)]
    checks.append((F.col("_known").isNull(), "Patient not found"))
    checks += _storage_checks(raw.columns)
    # Not broadcast: the patients grow with the data.
    return (raw.join(known, "patient_id", "left")
            .withColumn(REASON, first_reason(checks))
            .select(*raw.columns, REASON))


def validate_vitals(raw: DataFrame, patients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) vitals; rejected rows name their reason."""
    checked = check_vitals(raw, patients)
    return accepted(checked), rejected(checked)


# -- patients -----------------------------------------------------------------

def is_calendar_date(text: Column) -> Column:
    """Year of four digits, month, day, and a day that exists."""
    return (text.rlike(CALENDAR_DATE) & ~text.startswith("0000")
            & F.try_to_date(text, "y-M-d").isNotNull())


def too_long(value: Column, column: str) -> Column:
    """Longer than the patients table allows for the column."""
    return F.length(value) > TABLES["patients"].lengths[column]


def check_patients(raw: DataFrame, form: bool = False) -> DataFrame:
    """Raw patients with the reason of the first failed check, or NULL.

    ``form`` adds the check of the entry form, which refuses empty values too.
    """
    needed = ["first_name", "last_name", "date_of_birth"]
    checks = []
    for column in needed:
        missing = F.col(column).isNull()
        if form:
            missing |= F.col(column) == ""
        checks.append((missing, f"Missing required field: {column}"))
    checks += [(F.length(column) > NAME_LENGTH, f"Invalid {column}")
               for column in ("first_name", "last_name")]
    checks.append((~is_calendar_date(F.col("date_of_birth")), "Invalid date_of_birth format"))
    checks += [(too_long(F.col(column), column), f"Too long: {column}")
               for column in TABLES["patients"].lengths
               if column in raw.columns and column not in needed]
    return raw.withColumn(REASON, first_reason(checks))


def validate_patients(raw: DataFrame, form: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) patients; rejected rows name their reason."""
    checked = check_patients(raw, form)
    return accepted(checked), rejected(checked)


# -- declared constraints -----------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """One declared constraint. ``entity``: the table whose keys it is about, or none."""

    table: str
    rule: str
    column: str
    entity: str = ""


def declared_rules(held: Mapping[str, Iterable[str]]) -> list[Rule]:
    """The constraints that tables with these columns can break."""
    rules = []
    for name, columns in held.items():
        table = TABLES[name]
        rules += [Rule(name, "not_null", c) for c in table.required if c in columns]
        rules += [Rule(name, "length", c) for c in table.lengths if c in columns]
        rules.append(Rule(name, "unique", table.key, name))
        rules += [Rule(name, "foreign_key", c, parent)
                  for c, (parent, _) in table.references.items()
                  if c in columns and parent in held]
    return rules


def _marks(df: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """One row per broken row rule, and per key or reference held: one scan of a table."""
    def mark(number: int, rule: Rule) -> Column:
        column = F.col(rule.column)
        if rule.rule == "not_null":
            condition, value = column.isNull(), F.lit("")
        elif rule.rule == "length":
            limit = TABLES[rule.table].lengths[rule.column]
            condition, value = F.length(column) > limit, F.lit("")
        else:
            condition, value = column.isNotNull(), column.cast("string")
        return F.when(condition, F.struct(F.lit(number).alias("number"), value.alias("value")))

    marks = F.filter(F.array(*[mark(i, r) for i, r in rules]), lambda m: m.isNotNull())
    return df.select(F.explode(marks).alias("m")).select("m.number", "m.value")


def audit(t: Tables, names: list[str] | None = None) -> DataFrame:
    """Violations of every declared constraint that the tables can break.

    ``not_null`` and ``length`` count rows, ``unique`` counts repeated keys and
    ``foreign_key`` counts rows without their parent.

    Every table is read once. Keys, and references to them, meet as rows of one stream
    that is counted by entity and value, so no table is joined, and a value that very
    many rows share is counted before the shuffle.
    """
    names = list(t) if names is None else names
    rules = declared_rules({name: t[name].columns for name in names})
    numbered = list(enumerate(rules))
    streams = [_marks(t[name], [(i, r) for i, r in numbered if r.table == name])
               for name in names]
    # Numbers of the rules about keys; the others only have to be counted.
    keyed = [i for i, r in numbered if r.entity]
    entity = F.element_at(F.array(*[F.lit(names.index(r.entity) if r.entity else -1)
                                    for r in rules]), F.col("number") + 1)
    counted = (reduce(DataFrame.unionByName, streams)
               .groupBy(F.when(entity >= 0, entity).otherwise(-1 - F.col("number"))
                        .alias("entity"), "value")
               .agg(F.count(F.lit(1)).alias("rows"),
                    *[F.count_if(F.col("number") == i).alias(f"n{i}") for i in keyed]))
    found = []
    for i, rule in numbered:
        if rule.rule == "unique":
            broken = F.when(F.col(f"n{i}") > 1, 1)
        elif rule.rule == "foreign_key":
            parent = next(j for j, r in numbered if r.rule == "unique" and r.table == rule.entity)
            broken = F.when(F.col(f"n{parent}") == 0, F.col(f"n{i}"))
        else:
            broken = F.when(F.col("entity") == -1 - i, F.col("rows"))
        if rule.entity:
            broken = F.when(F.col("entity") == names.index(rule.entity), broken)
        found.append(F.coalesce(F.sum(broken), F.lit(0)).cast("bigint"))
    return counted.agg(F.array(*[
        F.struct(F.lit(r.table).alias("table_name"), F.lit(r.rule).alias("rule"),
                 F.lit(r.column).alias("column_name"), count.alias("violations"))
        for r, count in zip(rules, found, strict=True)]).alias("found")).select(F.inline("found"))
