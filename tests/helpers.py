"""Small hospital tables from a few written rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from wardflow.sources.schemas import TABLES

TODAY = date(2002, 1, 1)


def table(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """A declared table; columns that are not given are NULL."""
    schema = TABLES[name].schema
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)


def hospital(spark: SparkSession, **rows: list[dict]) -> dict[str, DataFrame]:
    return {name: table(spark, name, rows.get(name, [])) for name in TABLES}


def patient(key: str, born: date, **others) -> dict:
    return {"patient_id": key, "first_name": "Pat", "last_name": key, "date_of_birth": born,
            **others}
