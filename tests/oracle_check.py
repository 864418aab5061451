"""Compare registered queries with their SQL in DuckDB, types and values.

Also a script: ``python tests/oracle_check.py [test folder] [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def _contents(table) -> tuple[dict[str, str], Counter]:
    names = sorted(table.column_names)
    types = {n: str(table.schema.field(n).type).replace("large_", "") for n in names}
    columns = [table.column(n).to_pylist() for n in names]
    return types, Counter(zip(*[[_plain(v) for v in c] for c in columns])) if columns else Counter()


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str]:
    """(rows of the Spark result, what differs; empty if nothing does)."""
    spark_types, spark_rows = _contents(df.toArrow())
    duck_types, duck_rows = _contents(con.sql(sql).to_arrow_table())
    found = []
    if spark_types != duck_types:
        found.append("types: " + ", ".join(
            f"{n} {spark_types.get(n)} / {duck_types.get(n)}"
            for n in sorted({*spark_types, *duck_types})
            if spark_types.get(n) != duck_types.get(n)))
    if spark_rows != duck_rows:
        found.append(f"rows: {spark_rows.total()} / {duck_rows.total()}\n"
                     f"  only Spark: {str(list((spark_rows - duck_rows).elements())[:1])[:900]}\n"
                     f"  only SQL:   {str(list((duck_rows - spark_rows).elements())[:1])[:900]}")
    return spark_rows.total(), "\n".join(found)


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in oracles:
                rows, found = difference(query(spark, sf_dir), con, oracles[name])
            else:
                rows, found = query(spark, sf_dir).count(), ""
        except Exception as error:  # report every query, whatever one of them does
            rows, found = 0, f"{type(error).__name__}: {str(error)[:400]}"
        failed += bool(found)
        verdict = "DIFFERS" if found else "ok" if name in oracles else "ran"
        print(f"{name:28} {rows:8} rows {time.time() - start:6.2f} s  {verdict} {found}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
