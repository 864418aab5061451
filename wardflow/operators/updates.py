"""Changes to the tables: appends, partial updates and deletes.

Each function returns the new rows or the whole new table. Writing them is left
to the caller (``wardflow.sources.tables.write_table``), because a folder must
not be overwritten while it is being read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.functions import exprs as E
from wardflow.functions import skew
from wardflow.operators import quality as Q
from wardflow.session import settle
from wardflow.sources.clustered import ClusteredTable
from wardflow.sources.schemas import TABLES

# The form of a new patient id. The prefix, and the fields of a
# patient that may be set.
ID_PREFIX = "P"
ID_DIGITS = 32
PATIENT_FIELDS = ("first_name", "last_name", "date_of_birth", "gender", "email", "phone",
                  "address", "city", "state", "zip_code", "insurance_provider",
                  "insurance_id", "emergency_contact_name", "emergency_contact_phone")


def append_vitals(accepted: DataFrame, vitals: DataFrame, as_of_ts: datetime | None = None,
                  arrival: str = "row_id") -> DataFrame:
    """Accepted vitals as new rows of the vitals table.

    A time that was not sent becomes ``as_of_ts``. New ids follow the highest
    one in use, in the order of the unique whole number ``arrival``, so a
    repeated run gives the same ids.
    """
    placed = skew.number_table(accepted, arrival, "_place")
    highest = vitals.agg(F.coalesce(F.max("vital_id"), F.lit(0)).alias("id")).scalar()
    sent = F.col("recorded_at") if "recorded_at" in accepted.columns else F.lit(None)
    values = {"vital_id": highest + F.col("_place"),
              "recorded_at": F.coalesce(sent.cast("timestamp_ntz"), E.now(as_of_ts))}
    kept = {f.name: f.dataType for f in TABLES["vitals"].schema
            if f.name in values or f.name in accepted.columns}
    return placed.select(*[
        values[c].alias(c) if c in values else F.col(c).cast(type_).alias(c)
        for c, type_ in kept.items()])


def append_patients(accepted: DataFrame, patients: DataFrame, batch: str,
                    as_of_ts: datetime | None = None, arrival: str = "row_id") -> DataFrame:
    """Accepted patients as new rows, each with a new id.

    An id is the prefix and 32 upper-case hexadecimal digits, taken from a hash
    of the batch name and the ``arrival`` number, which is unique in its batch.
    So batches may number their rows alike, and a row whose id is stored has
    landed before: a batch that is run again adds only what did not land. Eight
    digits would clash from some ten thousand patients on, and a clash could not
    be told from a row that has landed.
    """
    digits = F.upper(F.sha2(F.concat_ws("|", F.lit(batch), F.col(arrival).cast("string")), 256))
    drawn = accepted.withColumn("patient_id", F.concat(
        F.lit(ID_PREFIX), F.substring(digits, 1, ID_DIGITS)))
    born = F.try_to_date("date_of_birth", "y-M-d")
    fields = [born.alias(c) if c == "date_of_birth" else F.col(c)
              for c in PATIENT_FIELDS if c in accepted.columns]
    return drawn.join(patients.select("patient_id"), "patient_id", "left_anti").select(
        "patient_id", *fields, E.now(as_of_ts).alias("created_at"),
        E.now(as_of_ts).alias("updated_at"))


# -- partial update -----------------------------------------------------------

def check_changes(changes: DataFrame, patients: DataFrame) -> DataFrame:
    """Update requests with the reason of the first failed check, or NULL.

    ``changes`` holds change_id, patient_id and ``fields``, a map of the
    supplied fields to their new text. The key is not a field that can change.
    """
    fields = F.col("fields")

    def supplied(column: str) -> Column:
        return F.map_contains_key(fields, column)

    checks = [(F.col("_known").isNull(), "Patient not found")]
    checks += [(supplied(c) & (fields[c].isNull() | (F.length(fields[c]) > Q.NAME_LENGTH)),
                f"Invalid {c}") for c in ("first_name", "last_name")]
    checks.append((supplied("date_of_birth")
                   & ~F.coalesce(Q.is_calendar_date(fields["date_of_birth"]), F.lit(False)),
                   "Invalid date_of_birth format"))
    names = F.array_remove(F.map_keys(fields), "patient_id")
    unknown = F.array_except(names, F.array(*[F.lit(c) for c in PATIENT_FIELDS]))
    checks.append((F.size(names) == 0, "No fields to update"))
    checks.append((F.size(unknown) > 0, "Unknown field"))
    checks += [(Q.too_long(fields[c], c), f"Too long: {c}") for c in PATIENT_FIELDS
               if c in TABLES["patients"].lengths]
    known = patients.select("patient_id", F.lit(True).alias("_known"))
    return (changes.join(known, "patient_id", "left")
            .withColumn(Q.REASON, Q.first_reason(checks))
            .select(*changes.columns, Q.REASON))


def apply_changes(patients: DataFrame, accepted: DataFrame,
                  as_of_ts: datetime | None = None) -> DataFrame:
    """The patients table after the accepted changes, later change_ids last.

    Only supplied fields change, also to NULL. ``updated_at`` is set where a
    value really differs.
    """
    settable = [c for c in PATIENT_FIELDS if c in patients.columns]
    fields = F.col("fields")
    # The last supplied value of each field. The struct keeps a supplied NULL
    # apart from a field that was not supplied.
    latest = accepted.groupBy("patient_id").agg(*[
        F.max_by(F.struct(fields[c].alias("value")),
                 F.when(F.map_contains_key(fields, c), F.col("change_id"))).alias(f"_new_{c}")
        for c in settable])

    def new(column: str) -> Column:
        value = F.col(f"_new_{column}.value")
        value = F.try_to_date(value, "y-M-d") if column == "date_of_birth" else value
        return F.when(F.col(f"_new_{column}").isNotNull(), value).otherwise(F.col(column))

    differs = F.lit(False)
    for column in settable:
        differs = differs | ~new(column).eqNullSafe(F.col(column))
    stamp = F.col("updated_at") if "updated_at" in patients.columns else F.lit(None)
    others = [c for c in patients.columns if c != "updated_at"]
    return patients.join(latest, "patient_id", "left").select(
        *[new(c).alias(c) if c in settable else F.col(c) for c in others],
        F.when(differs, E.now(as_of_ts)).otherwise(stamp.cast("timestamp_ntz"))
        .alias("updated_at"))


def partial_update(patients: DataFrame, changes: DataFrame,
                   as_of_ts: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(patients after the update, rejected changes with their reason)."""
    checked = check_changes(changes, patients)
    return apply_changes(patients, Q.accepted(checked), as_of_ts), Q.rejected(checked)


def write_back_changes(patients: ClusteredTable, changes: DataFrame,
                       as_of_ts: datetime | None = None) -> DataFrame:
    """Apply accepted changes to the written patients; returns the rejected ones.

    Only the buckets of patients with accepted changes are read again and rewritten.
    """
    checked = settle(check_changes(changes, patients.rows()), "checked-changes")
    accepted = Q.accepted(checked)
    patients.change(accepted.select("patient_id"),
                    lambda old: apply_changes(old, accepted, as_of_ts))
    return Q.rejected(checked)


def delete_by_key(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the rows whose key is listed."""
    return table.join(keys.select(key), key, "left_anti")
