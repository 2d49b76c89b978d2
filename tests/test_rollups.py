from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from estatescope.operators import rollups
from estatescope.plans import build_assessment
from estatescope.sources import empty_dataset
from estatescope.sources.schemas import INVENTORIES


def assessed(spark, ok, bad, finding="f"):
    rows = [([],)] * ok + [([finding],)] * bad
    return spark.createDataFrame(rows, "findings array<string>")


@pytest.mark.parametrize(
    "ok,bad,want",
    [(1, 0, 100.0), (0, 3, 0.0), (1, 2, 33.3), (2, 1, 66.7), (1, 15, 6.3), (1, 1999, 0.1), (0, 0, None)],
)
def test_readiness(spark, ok, bad, want):
    df = rollups.readiness_summary(spark, {"jobs": assessed(spark, ok, bad)})
    assert {r.object_type: r.readiness for r in df.collect()} == {"clusters": None, "jobs": want, "tables": None}


def test_readiness_of_nothing(spark):
    df = rollups.readiness_summary(spark, {})
    assert [tuple(r) for r in df.collect()] == [("clusters", None), ("jobs", None), ("tables", None)]


def test_assessment_summary_order(spark):
    parts = {
        "clusters": assessed(spark, 1, 2, "b"),
        "jobs": assessed(spark, 1, 2, "a"),
        "tables": assessed(spark, 0, 3, "c"),
    }
    got = [tuple(r) for r in rollups.assessment_summary(spark, parts).collect()]
    assert got == [("c", 3), ("a", 2), ("b", 2)]
    assert rollups.assessment_summary(spark, {"jobs": None}).count() == 0


def test_assessment_summary_counts_every_finding(spark):
    from checks.queries import _assessed, assessment_summary

    sf_dir = "/root/testdata/sf0.001"
    each = sum(
        df.agg(F.sum(F.size("findings")).alias("n")).first().n for df in _assessed(spark, sf_dir).values()
    )
    assert assessment_summary(spark, sf_dir).agg(F.sum("count").alias("n")).first().n == each


TABLES = INVENTORIES["tables"] + ", findings array<string>"


def table(database, name="t", kind="MANAGED", location=None, delta=False, findings=()):
    return (database, name, kind, None, location, 0, delta, "[]", None, list(findings))


def test_database_summary(spark):
    df = spark.createDataFrame(
        [
            table("a", location="dbfs:/x", findings=["f"]),
            table("a", kind="view"),
            table("a", name=None, delta=True),
            table("a", location="dbfs:/mnt/x", findings=["f", "g"]),
            table("b", delta=None),
            table(None),
        ],
        TABLES,
    )
    grants = spark.createDataFrame(
        [("a", "SCHEMA", "a", p, "x") for p in ("u", "u", "v", None)]
        + [("c", "SCHEMA", "c", "u", "x"), (None, "SCHEMA", None, "u", "x")],
        INVENTORIES["grants"],
    )
    got = {r.database: tuple(r)[1:] for r in rollups.database_summary(df, grants).collect()}
    assert got == {"a": (3, 1, 2, 1, 1, 3, 2), "b": (1, 0, 0, 0, 0, None, None)}
    alone = rollups.database_summary(df, None)
    assert alone.columns == ["database", "tables", "views", "unsupported", "dbfs_root", "delta_tables", "total_grants", "granted_principals"]
    assert {tuple(r)[6:] for r in alone.collect()} == {(None, None)}
    assert {r.database for r in rollups.grants_by_database(grants).collect()} == {"a", "c"}


def test_overview(spark):
    tables = spark.createDataFrame(
        [table("a")[:-1], table("a", kind="view")[:-1], table(None)[:-1], table("b", kind=None)[:-1]],
        INVENTORIES["tables"],
    )
    mounts = spark.createDataFrame([("/a", "s"), ("/b", "s")], INVENTORIES["mounts"])
    locations = spark.createDataFrame([("n", "u", "c", "o", False)], INVENTORIES["external_locations"])
    df = rollups.overview(spark, {"tables": tables, "mounts": mounts, "external_locations": locations, "udfs": None, "jobs": empty_dataset(spark, "jobs")})
    assert [tuple(r) for r in df.collect()] == [
        ("Total Databases", 2), ("Total Tables", 3), ("Total Views", 1), ("Total Storage Locations", 3),
        ("Total Jobs", 0), ("Total Clusters", 0), ("Total Pipelines", 0), ("Total UDFs", 0),
    ]
    assert {r.value for r in rollups.overview(spark, {}).collect()} == {0}


def test_assessment_of_missing_inventories(spark):
    results = build_assessment(spark, {})
    assert [name for name, df in results.items() if df is None] == ["storage_summary"]
    for name in ("clusters", "jobs", "tables"):
        assert results[name].columns == [*empty_dataset(spark, name).columns, "findings"]
        assert results[name].count() == 0
    assert results["database_summary"].count() == results["assessment_summary"].count() == 0
    assert {r.readiness for r in results["readiness_summary"].collect()} == {None}
    assert results["overview"].count() == 8
