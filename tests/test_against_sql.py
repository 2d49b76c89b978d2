"""Every registered query against its reference SQL, every row."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from checks.compare import duckdb_on, duckdb_rows, spark_rows
from checks.oracle_sql import ORACLE_SQL
from checks.queries import QUERIES
from checks.landed_sql import LANDED, landed, landed_cte

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    with duckdb_on(SF_DIR) as con:
        yield con


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE_SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", list(LANDED))
def test_landed_inputs_are_the_same_rows(spark, duck, name):
    df = landed(spark, SF_DIR, name)
    names, want = duckdb_rows(duck, f"WITH {landed_cte(name)} SELECT * FROM fx_{name}")
    assert sorted(df.columns) == names
    assert spark_rows(df) == want
    assert want.total() > 0


@pytest.mark.parametrize("key", list(QUERIES))
def test_same_rows_as_reference_sql(spark, duck, key):
    df = driver.queries()[key](spark, SF_DIR)
    names, want = duckdb_rows(duck, driver.oracle_sql()[key])
    assert sorted(df.columns) == names
    assert spark_rows(df) == want
    assert want.total() > 0


@pytest.mark.parametrize(
    "key", ["jobs_assessed", "storage_classes", "storage_summary", "tables_inventory", "database_summary"]
)
def test_same_rows_when_nothing_is_broadcast(spark, shuffled, duck, key):
    _, want = duckdb_rows(duck, driver.oracle_sql()[key])
    assert spark_rows(driver.queries()[key](spark, SF_DIR)) == want


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
