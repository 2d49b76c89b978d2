from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from estatescope.functions import findings, names, paths, text, versions


def values(spark, column, rows, kind="string"):
    """The value of ``column`` (of x) for each x in ``rows``."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_version_pair(spark):
    rows = ["11.3.x-scala2.12", "  9.1", "\t\n10.4", "11", "x11.3", "", None, ".3", "11.x", "007.010"]
    got = values(spark, versions.version_pair(F.col("x")), rows)
    pairs = [tuple(g) if g else None for g in got]
    assert pairs == [(11, 3), (9, 1), (10, 4), None, None, None, None, None, None, (7, 10)]


@pytest.mark.parametrize(
    "minimum,want",
    [
        ("11.3", [True, False, False, True, True, False, False, False]),
        (" 10.0.x", [True, False, False, False, False, False, False, False]),
        ("none", [False] * 8),
        (None, [False] * 8),
    ],
)
def test_is_below_compares_numbers(spark, minimum, want):
    rows = ["9.1.x", "11.3", "11.10", "11.2", "10.99", "custom:10.4", None, "99999999999999999999.1"]
    assert values(spark, versions.is_below(F.col("x"), minimum), rows) == want


def test_version_finding_keeps_the_raw_text(spark):
    got = values(spark, findings.version_finding(F.col("x"), "11.3"), [" 9.1.x ", "11.3", None])
    assert got == ["not supported DBR:  9.1.x ", None, None]


def test_access_mode_finding(spark):
    rule = findings.access_mode_finding(F.col("x"), ["NO_ISOLATION", "LEGACY", ""])
    got = values(spark, rule, ["NO_ISOLATION", "LEGACY", "legacy", "USER", "", None])
    assert got == [
        "No isolation shared clusters not supported in UC",
        "cluster type not supported : LEGACY",
        None,
        None,
        None,
        None,
    ]


@pytest.mark.parametrize("disallowed", [None, [], ["LEGACY"]])
def test_no_isolation_is_only_flagged_if_listed(spark, disallowed):
    rule = findings.access_mode_finding(F.col("x"), disallowed)
    assert values(spark, rule, ["NO_ISOLATION"]) == [None]


def test_finding_list_is_ordered_and_without_nulls_or_repeats(spark):
    lists = findings.finding_list(F.col("x"), F.lit("b"), F.lit(None).cast("string"), F.lit("b"))
    assert values(spark, lists, ["c", None]) == [["c", "b"], ["b"]]
    none = findings.finding_list(F.lit(None).cast("string"))
    assert values(spark, none, ["c"]) == [[]]


def test_is_view(spark):
    got = values(spark, findings.is_view(F.col("x")), ["VIEW", "view", "VIEWS", "", None])
    assert got == [True, True, False, False, False]


def test_format_and_location_findings(spark):
    got = values(spark, findings.format_finding(F.col("x")), ["delta", "DELTA", "csv", "", None])
    assert got == [None, None, "Non-DELTA format: CSV", None, None]
    rows = ["dbfs:/mnt/a", "/mnt/a", "dbfs:/mnt", "dbfs:/x", "DBFS:/x", "file:/dbfs/x", "", None]
    got = values(spark, findings.location_finding(F.col("x")), rows)
    mount, root = "Data is in DBFS Mount", "Data is in DBFS Root"
    assert got == [mount, mount, root, root, None, None, None, None]


def test_dbfs_root_excludes_only_the_mount_prefix(spark):
    got = values(spark, paths.is_dbfs_root(F.col("x")), ["dbfs:/x", "dbfs:/mnt", "dbfs:/mnt/x", "/mnt/x", None])
    assert got == [True, True, False, False, False]


def test_accessible_names(spark):
    rows = ["main.s", "system.s", "systems.s", "main.", "main", "main.a.b", ".s", None]
    got = values(spark, F.coalesce(names.is_accessible_name(F.col("x")), F.lit(False)), rows)
    assert got == [True, False, True, False, False, True, True, False]


def test_text_helpers(spark):
    assert values(spark, text.stripped(F.col("x")), ["\t a b \r\n", "", None]) == ["a b", "", None]
    first = text.non_empty_or(F.col("x"), F.lit("z"))
    assert values(spark, first, ["a", "", None]) == ["a", "z", "z"]
    assert values(spark, text.non_empty_or(F.lit(""), F.col("x")), ["a", "", None]) == ["a", "", None]
    json = text.as_json(F.struct(F.col("x").alias("k")))
    assert values(spark, json, ["a", None]) == ['{"k":"a"}', '{"k":null}']
