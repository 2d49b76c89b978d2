from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from estatescope.plans import run_assessment
from estatescope.sinks import REPORT_TABLES, SnapshotStore, write_report
from estatescope.sinks.report import flat_cells
from estatescope.sources.schemas import METADATA


@pytest.fixture
def store(spark, tmp_path):
    schema = "test_" + tmp_path.name.replace("-", "_")
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{tmp_path}/db'")
    yield SnapshotStore(spark, schema=schema, root=f"{tmp_path}/db")
    spark.sql(f"DROP DATABASE {schema} CASCADE")


def test_snapshot_overwrites_and_stamps(spark, store):
    assert not store.exists("t")
    stored = store.write("t", spark.range(5))
    assert store.exists("t") and stored.columns == ["id", "_crawled_at"]
    stamp = datetime.fromisoformat(stored.first()["_crawled_at"])
    assert stamp.utcoffset() == timedelta(0)
    store.write("t", spark.range(2), stamped_at="2024-01-01T00:00:00+00:00")
    assert [tuple(r) for r in store.read("t").orderBy("id").collect()] == [
        (0, "2024-01-01T00:00:00+00:00"),
        (1, "2024-01-01T00:00:00+00:00"),
    ]


def test_materialize_or_read(spark, store):
    built = []

    def build(n):
        def once():
            built.append(n)
            return spark.range(n)

        return once

    assert store.materialize_or_read("t", build(3)).count() == 3
    assert store.materialize_or_read("t", build(4)).count() == 3
    assert store.materialize_or_read("t", build(5), force_refresh=True).count() == 5
    assert built == [3, 5]
    assert "_crawled_at" in store.materialize_or_read("t", build(6)).columns


def test_a_failed_build_is_raised_and_keeps_what_is_stored(spark, store):
    store.write("t", spark.range(3))

    def fail():
        raise RuntimeError("no export")

    with pytest.raises(RuntimeError, match="no export"):
        store.materialize_or_read("t", fail, force_refresh=True)
    assert store.read("t").count() == 3


def breaking(spark, n):
    """Rows of which the last partition cannot be read."""
    return spark.range(0, n, 1, 4).select(
        F.when(F.col("id") < n - 1, F.col("id")).otherwise(F.raise_error(F.lit("broken record")).cast("long")).alias("id")
    )


def test_a_write_that_breaks_halfway_keeps_what_is_stored(spark, store, tmp_path):
    before = store.write("t", spark.range(3))
    files = sorted(p.name for p in (tmp_path / "db").iterdir())
    for _ in range(2):
        with pytest.raises(Exception, match="broken record"):
            store.write("t", breaking(spark, 100))
        assert store.read("t").count() == before.count() == 3
    assert sorted(p.name for p in (tmp_path / "db").iterdir()) == files
    assert spark.sql(f"SHOW TABLES IN {store.schema}").where("NOT isTemporary").count() == 1
    with pytest.raises(Exception, match="broken record"):
        store.write("u", breaking(spark, 10))
    assert not store.exists("u")


def test_readers_of_the_former_snapshot_go_on_reading(spark, store, tmp_path):
    first = store.keep("t", spark.range(3))
    store.keep("t", spark.range(5))
    assert first.count() == 3 and store.read("t").count() == 5
    store.keep("t", spark.range(7))
    assert store.read("t").count() == 7
    # The current snapshot and the former one.
    assert len(list((tmp_path / "db").iterdir())) == 2


def test_refreshes_at_the_same_time_leave_a_whole_snapshot(spark, store):
    from estatescope.sinks.together import run_together

    store.keep("t", spark.range(1))
    run_together(spark, [lambda n=n: store.keep("t", spark.range(0, n, 1, 4)) for n in (1000, 2000, 3000)])
    assert store.read("t").count() in (1000, 2000, 3000)
    assert store.keep("t", spark.range(2)).count() == 2


def test_a_snapshot_may_change_its_columns(spark, store):
    store.keep("t", spark.range(3))
    store.keep("t", spark.range(4).selectExpr("id AS other", "'x' AS text"))
    assert store.read("t").columns == ["other", "text"] and store.read("t").count() == 4


def test_measured_while_written(spark, store):
    stored, seen = store.measured("t", spark.range(5), total=F.count("*"), most=F.max("id"))
    assert stored.count() == 5 and seen == {"total": 5, "most": 4}
    _, seen = store.measured("t", spark.range(0), total=F.count("*"), most=F.max("id"))
    assert seen == {"total": 0, "most": None}


def test_snapshots_without_a_root_lie_in_the_schemas_folder(spark, store, tmp_path):
    own = SnapshotStore(spark, schema=store.schema)
    own.keep("t", spark.range(3))
    assert own.keep("t", spark.range(4)).count() == 4
    assert all(p.name.startswith("t_") for p in (tmp_path / "db").iterdir())


def test_flat_cells(spark):
    df = spark.range(1).select(
        F.array(F.lit("a"), F.lit('"')).alias("list"),
        F.create_map(F.lit("k"), F.lit(None).cast("string")).alias("map"),
        F.struct(F.lit(1).alias("x"), F.lit(None).cast("int").alias("y")).alias("a.b"),
        F.lit("text").alias("text"),
    )
    row = flat_cells(df).first()
    assert json.loads(row["list"]) == ["a", '"']
    assert json.loads(row["map"]) == {"k": None}
    assert json.loads(row["a.b"]) == {"x": 1, "y": None}
    assert row["text"] == "text"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_report(spark, tmp_path, fmt):
    clusters = spark.createDataFrame([("c", ['x "y", z', "w"])], "cluster_id string, findings array<string>")
    folders = write_report(spark, {"clusters": clusters, "jobs": None}, str(tmp_path), fmt)
    assert list(folders) == [name for _, name in REPORT_TABLES]
    reader = spark.read.option("header", True).option("escape", '"').format(fmt)
    row = reader.load(folders["clusters"]).first()
    assert (row.cluster_id, json.loads(row.findings)) == ("c", ['x "y", z', "w"])
    for name in ("jobs", "overview"):
        assert [tuple(r) for r in reader.load(folders[name]).collect()] == [("No data collected",)]


def test_run_with_few_exports_uses_what_is_stored(spark, store, tmp_path):
    mounts = spark.createDataFrame([("/mnt/a", "s")], METADATA["mounts"])
    run_assessment(spark, {"mounts": mounts}, store, f"{tmp_path}/first", 0, stamped_at="then")
    folders = run_assessment(spark, {}, store, f"{tmp_path}/second", 0)
    assert [tuple(r) for r in spark.read.parquet(folders["mounts"]).collect()] == [("/mnt/a", "s", "then")]
    counts = {r.metric: r.value for r in spark.read.parquet(folders["overview"]).collect()}
    assert counts["Total Storage Locations"] == 1 and counts["Total Tables"] == 0
    assert spark.read.parquet(folders["storage_summary"]).columns == ["info"]
    assert spark.read.parquet(folders["udfs"]).columns == ["info"]
    tables = spark.read.parquet(folders["tables"])
    assert tables.count() == 0 and tables.columns[-1] == "findings"
    assert spark.read.parquet(folders["readiness_summary"]).count() == 3
