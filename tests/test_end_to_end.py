"""Exports landed as files, read back, assessed and reported."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pytest

from checks import queries
from checks.landed_sql import AS_OF_MS, LANDED, landed
from estatescope.plans import build_assessment, build_inventories, run_assessment
from estatescope.sinks import SnapshotStore
from estatescope.sources import read_metadata, read_payloads, read_records
from estatescope.sources.schemas import RECORDS

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Every landed input as files: JSON lines for records, Parquet for metadata."""
    root = tmp_path_factory.mktemp("landed")
    for name in LANDED:
        df, path = landed(spark, SF_DIR, name), f"{root}/{name}"
        if name not in RECORDS:
            df.write.parquet(path)
        elif "payload" in df.columns:
            df.write.text(path)
        else:
            df.write.option("ignoreNullFields", False).json(path)
    return str(root)


def read_all(spark, folder, typed):
    def read(name):
        path = f"{folder}/{name}"
        if name not in RECORDS:
            return read_metadata(spark, name, path)
        return read_records(spark, name, path) if typed else read_payloads(spark, path)

    return {name: read(name) for name in LANDED}


@pytest.mark.parametrize("typed", [True, False])
def test_inventories_from_files(spark, folder, typed):
    want = build_inventories({n: landed(spark, SF_DIR, n) for n in LANDED}, AS_OF_MS)
    got = build_inventories(read_all(spark, folder, typed), AS_OF_MS)
    for name, df in want.items():
        assert sorted(map(tuple, got[name].collect()), key=str) == sorted(
            map(tuple, df.collect()), key=str
        ), name


def test_report_from_files(spark, folder, tmp_path):
    spark.sql(f"CREATE DATABASE from_files LOCATION '{tmp_path}/db'")
    store = SnapshotStore(spark, schema="from_files", root=f"{tmp_path}/db")
    source = read_all(spark, folder, typed=True)
    folders = run_assessment(spark, source, store, f"{tmp_path}/report", AS_OF_MS, stamped_at="now")
    want = build_assessment(spark, build_inventories(source, AS_OF_MS))
    for name, df in want.items():
        got = spark.read.parquet(folders[name]).drop("_crawled_at")
        rows = [r.asDict() for r in got.collect()]
        for row in rows:
            for column in ("findings", "dbr_versions"):
                if column in row:
                    row[column] = json.loads(row[column])
        expected = [r.asDict() for r in df.collect()]
        assert sorted(map(str, rows)) == sorted(map(str, expected)), name
    stamps = spark.read.parquet(folders["jobs"]).select("_crawled_at").distinct().collect()
    assert [r[0] for r in stamps] == ["now"]
    spark.sql("DROP DATABASE from_files CASCADE")


def session(**conf):
    held = {k.replace("_", "."): v for k, v in conf.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: held.get(k, d)))


def test_written_tables_go_to_the_shared_folder():
    on_cluster = session(spark_checkpoint_dir="hdfs:///c", spark_app_id="a1")
    assert queries._shared_folder(on_cluster, "x") == "hdfs:///c/estatescope/a1/x"
    without = session(spark_sql_warehouse_dir="file:/w", spark_app_id="a1")
    assert queries._shared_folder(without, "x") == "file:/w/estatescope/a1/x"
