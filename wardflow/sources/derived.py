"""Hospital tables derived from the star-schema test tables.

The same text runs in Spark and, with ``DIV`` written ``//``, in DuckDB, so an
oracle can start from the same rows. The content is deliberate: NULLs and empty
strings, mixed case, shared timestamps, patients without child rows, and raw
feeds with every kind of fault.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PATIENT = "'P'||lpad(CAST({0} AS STRING),8,'0')"
_BORN = "DATE '1935-01-01' + CAST((c_custkey*7919)%21900 AS INT)"
_OF_CUSTOMER = _PATIENT.format("c_custkey")
_OF_ORDER = _PATIENT.format("o_custkey")

DERIVED = {
    "patients": f"""
SELECT {_OF_CUSTOMER} AS patient_id, 'Pat' AS first_name, substring(c_name,10,9) AS last_name,
  {_BORN} AS date_of_birth,
  CASE c_custkey%5 WHEN 0 THEN 'Female' WHEN 1 THEN 'female' WHEN 2 THEN 'Female' WHEN 3 THEN 'Male' END AS gender,
  CASE WHEN c_custkey%7=0 THEN NULL WHEN c_custkey%11=0 THEN '' ELSE 'p'||CAST(c_custkey AS STRING)||'@example.com' END AS email,
  CASE WHEN c_custkey%13=0 THEN NULL ELSE '555-'||lpad(CAST(c_custkey%10000 AS STRING),4,'0') END AS phone,
  CASE WHEN c_custkey%17=0 THEN NULL ELSE n_name END AS city, r_name AS state,
  CASE WHEN c_mktsegment='BUILDING' THEN NULL ELSE c_mktsegment END AS insurance_provider
FROM {{customer}} JOIN {{nation}} ON c_nationkey=n_nationkey JOIN {{region}} ON n_regionkey=r_regionkey""",
    "vitals": f"""
SELECT o_orderkey AS vital_id, {_OF_ORDER} AS patient_id, o_orderdate AS recorded_at,
  CASE WHEN o_orderkey%19=0 THEN NULL ELSE CAST((360+(o_orderkey*13)%30)/10.0 AS DECIMAL(5,2)) END AS temperature,
  CAST(55+(o_orderkey*17)%60 AS INT) AS heart_rate,
  CASE WHEN o_orderkey%23=0 THEN NULL ELSE CAST(95+(o_orderkey*31)%60 AS INT) END AS blood_pressure_systolic,
  CASE WHEN o_orderkey%29=0 THEN NULL ELSE CAST(55+(o_orderkey*37)%45 AS INT) END AS blood_pressure_diastolic,
  CASE WHEN o_orderkey%31=0 THEN NULL ELSE CAST(12+o_orderkey%12 AS INT) END AS respiratory_rate,
  CAST((920+(o_orderkey*7)%80)/10.0 AS DECIMAL(5,2)) AS oxygen_saturation
FROM {{orders}}""",
    "medical_history": f"""
SELECT o_orderkey AS history_id, {_OF_ORDER} AS patient_id,
  CASE (o_orderkey DIV 7)%6 WHEN 0 THEN 'Chronic Hypertension' WHEN 1 THEN 'Gestational diabetes' WHEN 2 THEN 'Asthma'
    WHEN 3 THEN 'Anemia' WHEN 4 THEN 'hypertension' ELSE 'Migraine' END AS condition_name,
  CAST(o_orderdate AS DATE) AS diagnosis_date
FROM {{orders}} WHERE o_orderkey%7=0""",
    "delivery_information": f"""
SELECT o_orderkey AS delivery_id, {_OF_ORDER} AS patient_id, CAST(o_orderdate AS DATE) AS delivery_date,
  CASE (o_orderkey DIV 11)%4 WHEN 0 THEN 'Vaginal' WHEN 1 THEN 'C-section' WHEN 2 THEN 'c-section' ELSE 'Assisted' END AS delivery_method,
  CASE (o_orderkey DIV 11)%5 WHEN 0 THEN 'Preeclampsia' WHEN 1 THEN '' WHEN 2 THEN 'Hemorrhage' END AS complications,
  CAST((250+(o_orderkey*7)%200)/100.0 AS DECIMAL(5,2)) AS birth_weight,
  'Dr '||lpad(CAST((o_orderkey DIV 11)%19 AS STRING),2,'0') AS attending_doctor
FROM {{orders}} WHERE o_orderkey%11=0""",
    "follow_up_visits": f"""
SELECT o_orderkey AS visit_id, {_OF_ORDER} AS patient_id, CAST(o_orderdate AS DATE) AS visit_date,
  CASE o_orderkey%4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS follow_up_required,
  CASE WHEN o_orderkey%5=0 THEN NULL ELSE CAST(o_orderdate AS DATE)+CAST(7+(o_orderkey*3)%360 AS INT) END AS follow_up_date
FROM {{orders}} WHERE o_orderkey%3=0""",
    "appointments": f"""
SELECT o_orderkey AS appointment_id, {_OF_ORDER} AS patient_id, CAST(o_orderkey%19 AS INT) AS doctor_id,
  o_orderdate + INTERVAL '30' DAY + INTERVAL '9' HOUR AS appointment_date,
  CASE o_orderkey%3 WHEN 0 THEN 'Checkup' WHEN 1 THEN 'Scan' END AS reason, 'Scheduled' AS status
FROM {{orders}} WHERE o_orderkey%13=0""",
    "medications": f"""
SELECT o_orderkey AS medication_id, {_OF_ORDER} AS patient_id,
  CASE (o_orderkey DIV 17)%3 WHEN 0 THEN 'Labetalol' WHEN 1 THEN 'Insulin' ELSE 'Iron' END AS medication_name,
  CAST(o_orderdate AS DATE) AS start_date,
  CASE WHEN (o_orderkey DIV 17)%2=0 THEN CAST(o_orderdate AS DATE)+CAST(30+o_orderkey%400 AS INT) END AS end_date
FROM {{orders}} WHERE o_orderkey%17=0""",
    "doctors": """
SELECT CAST(s_suppkey AS INT) AS doctor_id, 'Dr' AS first_name, lpad(CAST(s_suppkey AS STRING),2,'0') AS last_name
FROM {supplier} WHERE s_suppkey<19""",
    "raw_vitals": f"""
SELECT o_orderkey AS row_id, CASE WHEN o_orderkey%37=0 THEN 'PMISSING' ELSE {_OF_ORDER} END AS patient_id,
  o_orderdate AS recorded_at,
  CASE o_orderkey%10 WHEN 0 THEN '45.1' WHEN 1 THEN 'abc' WHEN 2 THEN NULL WHEN 3 THEN '30' WHEN 4 THEN '45' ELSE '36.6' END AS temperature,
  CASE o_orderkey%9 WHEN 0 THEN '29' WHEN 1 THEN '72.5' WHEN 2 THEN NULL WHEN 3 THEN '220' ELSE '80' END AS heart_rate,
  CAST(60+(o_orderkey*7)%200 AS INT) AS blood_pressure_systolic, CAST(35+(o_orderkey*11)%120 AS INT) AS blood_pressure_diastolic
FROM {{orders}}""",
    "raw_patients": f"""
SELECT c_custkey AS row_id,
  CASE c_custkey%11 WHEN 0 THEN NULL WHEN 1 THEN repeat('x',101) WHEN 2 THEN '' ELSE 'Pat' END AS first_name,
  CASE c_custkey%13 WHEN 0 THEN NULL WHEN 1 THEN repeat('y',101) ELSE substring(c_name,10,9) END AS last_name,
  CASE c_custkey%17 WHEN 0 THEN NULL WHEN 1 THEN '1990-02-30' WHEN 2 THEN '1990' WHEN 3 THEN '01/02/1990' WHEN 4 THEN '1990-2-3'
    WHEN 5 THEN '' WHEN 6 THEN '1990-13-01' ELSE CAST({_BORN} AS STRING) END AS date_of_birth,
  CASE c_custkey%5 WHEN 3 THEN 'Male' WHEN 4 THEN NULL ELSE 'Female' END AS gender,
  CASE WHEN c_custkey%19=0 THEN repeat('z',101) ELSE 'p'||CAST(c_custkey AS STRING)||'@example.com' END AS email
FROM {{customer}}""",
    "raw_changes": f"""
SELECT o_orderkey AS change_id, CASE WHEN o_orderkey%41=0 THEN 'PMISSING' ELSE {_OF_ORDER} END AS patient_id,
  o_orderkey%3=0 AS sets_phone, CASE WHEN o_orderkey%6=0 THEN NULL ELSE '555-'||lpad(CAST(o_orderkey%10000 AS STRING),4,'0') END AS phone,
  o_orderkey%5=0 AS sets_city, 'City '||CAST(o_orderkey%7 AS STRING) AS city,
  o_orderkey%7=0 AS sets_last_name, CASE o_orderkey%28 WHEN 0 THEN repeat('z',101) WHEN 7 THEN NULL ELSE 'Renamed' END AS last_name,
  o_orderkey%11=0 AS sets_date_of_birth, CASE WHEN o_orderkey%22=0 THEN '1990-02-30' ELSE '1980-02-29' END AS date_of_birth,
  o_orderkey%23=0 AS sets_nickname, 'Nick' AS nickname
FROM {{orders}}""",
}

# The columns of the test tables that the derivations read.
SOURCES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
}


def _sources_of(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", DERIVED[name])


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCES[name]).parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, name: str, sources: dict[str, DataFrame]) -> DataFrame:
    """One derived table over the given source frames (batch or streaming)."""
    return spark.sql(DERIVED[name], **{s: sources[s] for s in _sources_of(name)})


class HospitalTables(dict):
    """The derived tables of one test folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        sources = {s: read_source(self.spark, self.sf_dir, s) for s in _sources_of(name)}
        self[name] = derive(self.spark, name, sources)
        return self[name]


def changes_as_maps(raw_changes: DataFrame) -> DataFrame:
    """Update requests as (change_id, patient_id, fields): the supplied fields only."""
    entries = [
        F.when(F.col(c), F.struct(F.lit(c.removeprefix("sets_")).alias("key"),
                                  F.col(c.removeprefix("sets_")).alias("value")))
        for c in raw_changes.columns if c.startswith("sets_")]
    return raw_changes.select(
        "change_id", "patient_id",
        F.map_from_entries(F.array_compact(F.array(*entries))).alias("fields"))


def oracle_ctes(*names: str) -> str:
    """A WITH clause that defines the named tables for DuckDB."""
    def text(name: str) -> str:
        body = re.sub(r"\{(\w+)\}", r"\1", DERIVED[name]).replace(" DIV ", " // ")
        return f"{name} AS ({body})"
    return "WITH " + ",\n".join(text(n) for n in names)
