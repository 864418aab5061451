"""Readers and sinks for the hospital tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.sources.schemas import TABLES


def read_tables(spark: SparkSession, root: str,
                names: Iterable[str] = tuple(TABLES)) -> dict[str, DataFrame]:
    """The named tables under ``root``, one parquet folder each.

    The schema is declared, so opening a table reads no data file.
    """
    return {name: spark.read.schema(TABLES[name].schema).parquet(f"{root}/{name}")
            for name in names}


def read_jdbc(spark: SparkSession, url: str, name: str, properties: dict[str, str],
              lower: int | None = None, upper: int | None = None,
              partitions: int = 1) -> DataFrame:
    """One table over JDBC, read in ``partitions`` ranges of its key.

    ``lower`` and ``upper`` set the stride only; rows outside them are read
    too. Tables with a text key are read by one connection.
    """
    if lower is None or upper is None:
        return spark.read.jdbc(url, name, properties=properties)
    return spark.read.jdbc(url, name, column=TABLES[name].key, lowerBound=lower,
                           upperBound=upper, numPartitions=partitions,
                           properties=properties)


def write_table(df: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    """Write a table in its declared columns; absent ones become NULL or default."""
    table = TABLES[name]
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(table.defaults.get(f.name)))
        .cast(f.dataType).alias(f.name)
        for f in table.schema]
    df.select(*columns).write.mode(mode).parquet(f"{root}/{name}")


# ISO 8601 text of dates and timestamps in JSON results.
JSON_OPTIONS = {
    "dateFormat": "yyyy-MM-dd",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss",
    "ignoreNullFields": "false",
}


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object; missing values are written as null."""
    return df.select(F.to_json(F.struct(*df.columns), JSON_OPTIONS).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a result as JSON lines with ISO dates."""
    df.write.mode(mode).options(**JSON_OPTIONS).json(path)
