"""The nested patient profile."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions import scan
from wardflow.sources.schemas import TABLES

Tables = Mapping[str, DataFrame]

# Child tables of a profile. Those with a column are listed by it, newest
# first; the others in the order of their ids.
SECTIONS = {
    "medical_history": None,
    "vitals": "recorded_at",
    "medications": None,
    "appointments": "appointment_date",
    "delivery_information": None,
}


def _entries(child: DataFrame, section: str) -> DataFrame:
    """One row per entry: its sort columns, and the entry itself as a struct."""
    moment, number = SECTIONS[section], F.col(TABLES[section].key).cast("bigint")
    when = F.col(moment) if moment else F.lit(None)
    return child.select("patient_id", F.lit(section).alias("_section"),
                        when.cast("timestamp_ntz").alias("_moment"),
                        (-number if moment else number).alias("_number"),
                        F.struct(*child.columns).alias(section))


def profile_entries(t: Tables, patient_id: str | None = None) -> DataFrame:
    """The entries of all sections, and one row without an entry per patient."""
    def of_patient(name: str) -> DataFrame:
        table = t[name]
        return table if patient_id is None else table.filter(F.col("patient_id") == patient_id)

    entries = of_patient("patients").select(
        "patient_id", F.lit("").alias("_section"),
        F.lit(None).cast("timestamp_ntz").alias("_moment"),
        F.lit(0).cast("bigint").alias("_number"))
    for section in SECTIONS:
        entries = entries.unionByName(_entries(of_patient(section), section),
                                      allowMissingColumns=True)
    return entries


def _list(section: str) -> Column:
    """The entries of a section on one page, in their order."""
    entry = f"CASE WHEN {section} IS NOT NULL THEN struct(_place, {section}) END"
    return F.expr(f"sort_array(collect_list({entry})).{section}").alias(section)


def patient_profile(t: Tables, patient_id: str | None = None,
                    page_size: int = 1000) -> DataFrame:
    """Each patient with five lists of child rows; one patient if an id is given.

    Vitals and appointments are listed newest first. Page 0 holds the first
    ``page_size`` entries of every list, which for nearly all patients is
    everything. Longer lists go on in rows with page 1, 2, ..., so no row grows
    with the number of entries.
    """
    # A row without an entry gives every patient a page 0.
    placed = scan.numbered(profile_entries(t, patient_id), ["patient_id", "_section"],
                           [F.desc("_moment"), F.asc("_number")], "_place")
    pages = (placed.withColumn("page", F.floor((F.col("_place") - 1) / page_size))
             .groupBy("patient_id", "page").agg(*[_list(s) for s in SECTIONS]))
    patients = t["patients"]
    if patient_id is not None:
        patients = patients.filter(F.col("patient_id") == patient_id)
    return pages.join(patients, "patient_id").select(*patients.columns, "page", *SECTIONS)
