"""Run queries in Spark and DuckDB and compare every row.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession


def duckdb_on(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """An in-process connection with the tables of ``sf_dir`` as views."""
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def spark_rows(df: DataFrame) -> Counter:
    columns = sorted(df.columns)
    return Counter(tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect())


def duckdb_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(row[i] for i in order) for row in cursor.fetchall())
    return sorted(names), rows


def main() -> None:
    from checks.oracle_sql import ORACLE_SQL
    from checks.queries import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_on(sf_dir)
    bad = 0
    for key in chosen:
        began = time.time()
        df = QUERIES[key](spark, sf_dir)
        got = spark_rows(df)
        took = time.time() - began
        names, want = duckdb_rows(con, ORACLE_SQL[key])
        same = sorted(df.columns) == names and got == want
        bad += not same
        print(f"{'ok ' if same else 'BAD'} {key}: {sum(got.values())} rows, {took:.2f} s")
        if not same:
            print("   columns", sorted(df.columns), names)
            print("   spark only", list((got - want).items())[:3])
            print("   duckdb only", list((want - got).items())[:3])
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
