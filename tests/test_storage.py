from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from estatescope.operators import storage

EXTERNAL = ["s3://b", "s3a://b", "abfss://c@a/x", "wasbs://c@a", "gs://b", "adl://a"]


def tables(spark, locations):
    return spark.createDataFrame([(i, x) for i, x in enumerate(locations)], "i int, location string")


def mounts(spark, points):
    return spark.createDataFrame([(p, "s") for p in points], "mountPoint string, source string")


def check(spark, locations, points, want):
    """``want``: the class of each location, in order."""
    df, at = tables(spark, locations).repartition(4), mounts(spark, points)
    classes = storage.storage_classes(df, at)
    assert classes.columns == ["i", "location", "storage_type"]
    got = [(r.i, r.storage_type) for r in classes.collect()]
    assert sorted(got) == list(enumerate(want))
    counts = {r.storage_type: r.table_count for r in storage.storage_summary(df, at).collect()}
    assert counts == {c: list(want).count(c) for c in set(want)}


# Locations with their class where there are no mount points.
EDGES = {
    **dict.fromkeys(EXTERNAL, "EXTERNAL"),
    **dict.fromkeys([None, "", "S3://b", "s3n://b", "/mnt", "dbfs:", "hdfs:/vol/n3"], "UNSUPPORTED"),
    **dict.fromkeys(["dbfs:/mnt/x", "/mnt/x"], "DBFS_MOUNT"),
    **dict.fromkeys(
        [
            "dbfs:/mnt", "dbfs:/", "file:/dbfs/", "file:/dbfs/mnt/x", "file:/dbfs/vol/n3/t", "dbfs:/vol/n3",
            "dbfs:/vol/n", "dbfs:/VOL/n3", "dbfs:/vol/n33/x", "dbfs:/a/é/b", "dbfs:/a/日本/b",
        ],
        "DBFS_ROOT",
    ),
}
ROOTS = {k for k, v in EDGES.items() if v == "DBFS_ROOT"}
N3 = {"file:/dbfs/vol/n3/t", "dbfs:/vol/n3", "dbfs:/vol/n33/x"}


@pytest.mark.parametrize(
    "points, mounted",
    [
        ([], set()),
        (["/vol/n3"], N3),
        (["/vol/n3", "/vol/n3", "/vol", "/nothing"], N3 | {"dbfs:/vol/n"}),
        (["é/b", "本", None], {"dbfs:/a/é/b", "dbfs:/a/日本/b"}),
        ([""], ROOTS),
        (["dbfs:/vol/n33/x/longer/than/any", ":/v"], {"dbfs:/vol/n3", "dbfs:/vol/n", "dbfs:/vol/n33/x"}),
        ([None], set()),
    ],
)
def test_edges(spark, points, mounted):
    want = ["DBFS_MOUNT" if x in mounted else c for x, c in EDGES.items()]
    check(spark, list(EDGES), points, want)


def test_against_sql_with_hot_locations(spark, shuffled):
    """One location with a mount point and one without hold half of the tables."""
    rng = random.Random(3)

    def path(n):
        return "/".join("".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(n))

    points = ["/" + path(rng.randint(1, 2)) for _ in range(25)] + ["b/a", "ab/"]
    locations = ["dbfs:/hot/ab/a"] * 300 + ["dbfs:/cold"] * 200
    locations += [rng.choice(["dbfs:/", "file:/dbfs/", "s3://", ""]) + path(rng.randint(1, 4)) for _ in range(500)]
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"i": range(len(locations)), "location": locations}))
    con.register("p", pd.DataFrame({"point": points}))
    want = con.execute(
        """SELECT CASE regexp_extract(location, '^([a-z0-9]+:/)')
             WHEN '' THEN 'UNSUPPORTED' WHEN 's3:/' THEN 'EXTERNAL'
             ELSE coalesce((SELECT max('DBFS_MOUNT') FROM p WHERE contains(location, point)), 'DBFS_ROOT') END
           FROM t ORDER BY i"""
    ).fetchall()
    check(spark, locations, points, [w for (w,) in want])


def test_missing_mounts_are_no_mounts(spark):
    df = tables(spark, ["dbfs:/vol/n3", "s3://b"])
    for at in (None, mounts(spark, []), spark.createDataFrame([("x",)], "other string")):
        got = {r.location: r.storage_type for r in storage.storage_classes(df, at).collect()}
        assert got == {"dbfs:/vol/n3": "DBFS_ROOT", "s3://b": "EXTERNAL"}
        counts = {r.storage_type: r.table_count for r in storage.storage_summary(df, at).collect()}
        assert counts == {"DBFS_ROOT": 1, "EXTERNAL": 1}


def test_location_is_required(spark):
    for operator in (storage.storage_classes, storage.storage_summary):
        with pytest.raises(ValueError, match="location"):
            operator(spark.range(1), None)


def test_counts_add_up_to_the_tables(spark):
    from checks.queries import storage_summary, tables_inventory

    sf_dir = "/root/testdata/sf0.001"
    total = storage_summary(spark, sf_dir).agg(F.sum("table_count").alias("n")).first().n
    assert total == tables_inventory(spark, sf_dir).count()
