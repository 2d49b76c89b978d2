"""What the physical plans must and must not contain."""

from __future__ import annotations

import io
import json
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from checks import queries
from checks.queries import QUERIES
from estatescope.operators import inventory, kept, metadata, rules, skew, storage
from estatescope.plans import run_assessment
from estatescope.sinks import SnapshotStore
from estatescope.sources.schemas import INVENTORIES, METADATA

SF_DIR = "/root/testdata/sf0.001"
STORED = ("snapshot_write", "snapshot_read", "materialize_or_read", "report_tables", "landed_files", "combined_exports")


def plan(df, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in STORED])
def test_no_python_and_no_nested_loops(spark, shuffled, key):
    text = plan(QUERIES[key](spark, SF_DIR))
    for operator in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "WindowExec"):
        assert operator not in text


@pytest.mark.parametrize(
    "key",
    [
        "clusters_inventory", "cluster_policies_inventory", "jobs_inventory", "pipelines_inventory",
        "submit_runs_inventory", "external_locations_inventory", "init_scripts_inventory",
        "grants_inventory", "mounts_inventory", "clusters_assessed", "unsupported_versions",
        "disallowed_access_modes", "unreadable_records",
    ],
)
def test_projections_do_not_shuffle(spark, key):
    assert "Exchange" not in plan(QUERIES[key](spark, SF_DIR))


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in STORED])
def test_nothing_is_dealt_round_robin(spark, key):
    assert "RoundRobinPartitioning" not in plan(QUERIES[key](spark, SF_DIR))


def test_records_are_parsed_once(spark):
    for key in ("clusters_inventory", "pipelines_inventory", "submit_runs_inventory", "jobs_inventory"):
        text = plan(QUERIES[key](spark, SF_DIR), "simple")
        assert text.count("from_json(") == 1, key


def stored(spark, tmp_path, kind, schemas):
    path = str(tmp_path / kind)
    spark.createDataFrame([], schemas[kind]).write.parquet(path)
    return spark.read.schema(schemas[kind]).parquet(path)


def test_stored_tables_are_pruned_and_filtered_at_the_scan(spark, tmp_path):
    tables = stored(spark, tmp_path, "tables", INVENTORIES)
    text = plan(storage.counted_locations(tables))
    assert "ReadSchema: struct<location:string>" in text
    details = stored(spark, tmp_path, "table_details", METADATA)
    listed = stored(spark, tmp_path, "table_list", METADATA)
    types = stored(spark, tmp_path, "table_types", METADATA)
    text = plan(metadata.tables_inventory(listed, types, details))
    assert "Not(StringStartsWith(catalog_schema,system.))" in text
    assert "Not(EqualTo(table_catalog,system))" in text
    grants = stored(spark, tmp_path, "grants", METADATA)
    assert "EqualTo(object_type,SCHEMA)" in plan(metadata.grants_inventory(grants))


def test_table_lookups_share_the_shuffle_of_their_join(spark, shuffled, tmp_path):
    parts = [stored(spark, tmp_path, k, METADATA) for k in ("table_list", "table_types", "table_details")]
    text = plan(metadata.tables_inventory(*parts), "simple")
    assert text.count("Exchange hashpartitioning") == 3


def test_unkeyed_and_hot_facts_are_spread(spark, shuffled, tmp_path):
    jobs = stored(spark, tmp_path, "jobs", INVENTORIES)
    clusters = stored(spark, tmp_path, "clusters", INVENTORIES)
    text = plan(rules.assess_jobs(jobs, rules.assess_clusters(clusters)), "simple")
    assert "hashpartitioning(_cold_key" in text
    assert all("_slot" in line for line in text.splitlines() if "hashpartitioning(_cold_key" in line)
    # Only heavy keys are broadcast.
    joins = [line for line in text.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("_hot_key" in line for line in joins)


@pytest.fixture
def written(monkeypatch):
    """The plans of all tables that operators write in between."""
    plans = []

    def noted(df, purpose, **metrics):
        plans.append(plan(df))
        return kept.kept(df, purpose, **metrics)

    for module in (rules, skew, storage, queries):
        monkeypatch.setattr(module, "kept", noted)
    return plans


def scans(texts, location):
    """How often the files of a folder are read."""
    return sum(line.startswith("Location:") and location in line for text in texts for line in text.splitlines())


def test_jobs_are_read_for_their_lists_and_for_the_join(spark, written):
    df = QUERIES["jobs_assessed"](spark, SF_DIR)
    texts = [*written, plan(df)]
    assert scans(texts, "/orders.parquet") == 1 and scans(texts, "/supplier.parquet") == 1
    assert scans(texts, "/jobs-") == 2
    assert plan(df, "simple").count("from_json(") == 0


@pytest.mark.parametrize("key", ["storage_classes", "storage_summary"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_tables_are_read_for_the_count_and_the_join(spark, written, request, key, broadcast):
    if not broadcast:
        request.getfixturevalue("shuffled")
    df = QUERIES[key](spark, SF_DIR)
    texts = [*written, plan(df)]
    # Each assembly reads listing, types and details, which are made of one table.
    assert scans(texts, "/part.parquet") <= (6 if key == "storage_classes" else 3)
    assert scans(texts, "/supplier.parquet") <= 5


def test_rollups_do_not_run_the_rules_again(spark, written):
    for key in ("readiness_summary", "assessment_summary"):
        written.clear()
        df = QUERIES[key](spark, SF_DIR)
        assert scans([plan(df)], "/orders.parquet") == 0
        assert scans(written, "/orders.parquet") == 1, key


def test_stored_parts_join_without_moving_rows(spark, shuffled):
    df = QUERIES["stored_table_parts"](spark, SF_DIR)
    assert "SortMergeJoin" in plan(df) and "Exchange" not in plan(df)
    assert "Exchange" not in plan(rules.assess_tables(df))
    # Only what is new is moved: locations with their counts, and databases.
    text = plan(storage.counted_locations(df), "simple")
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_the_overview_parses_one_field_per_record(spark):
    text = plan(QUERIES["overview"](spark, SF_DIR), "simple")
    for kind, field in (("clusters", "cluster_id"), ("jobs", "job_id"), ("pipelines", "pipeline_id"), ("external_locations", "name")):
        assert f"from_json(StructField({field}," in text, kind
    assert "inline" in text and "/lineitem.parquet" not in text


def test_described_functions_are_dealt_once(spark, shuffled, tmp_path):
    parts = [stored(spark, tmp_path, k, METADATA) for k in ("udf_list", "udf_info")]
    text = plan(metadata.udfs_inventory(*parts), "simple")
    assert text.count("Exchange hashpartitioning") == 2


def test_a_payload_that_is_worked_out_is_made_once(spark):
    raw = spark.range(3).select(F.concat(F.lit('{"job_id":'), "id", F.lit("}")).alias("payload"))
    df = inventory.jobs_inventory(raw)
    assert plan(df, "simple").count("concat(") == 1
    assert sorted(r.job_id for r in df.collect()) == [0, 1, 2]


def test_stored_jobs_are_assessed_without_parsing(spark, shuffled, written, tmp_path):
    records = (
        '{"job_id": 1, "settings": {"tasks": [{"existing_cluster_id": "b"}, {"task_key": "t"}, {"existing_cluster_id": "a"}]}}',
        '{"job_id": 2, "settings": {"tasks": []}}',
        '{"job_id": 3}',
    )
    clusters = [('{"cluster_id": "a", "spark_version": "9.1"}',), ('{"cluster_id": "b", "spark_version": "10.0"}',)]
    landed = {
        "jobs": spark.createDataFrame([(r,) for r in records], "payload string"),
        "clusters": spark.createDataFrame(clusters, "payload string"),
    }
    spark.sql(f"CREATE DATABASE stored_jobs LOCATION '{tmp_path}/db'")
    store = SnapshotStore(spark, schema="stored_jobs", root=f"{tmp_path}/db")
    folders = run_assessment(spark, landed, store, f"{tmp_path}/report", 0, stamped_at="now")
    assert written and not any("from_json" in text for text in written)
    ids = {r.job_id: r.task_cluster_ids for r in store.read("jobs").collect()}
    assert ids == {1: ["b", "a"], 2: [], 3: []}
    rows = spark.read.parquet(folders["jobs"])
    assert "task_cluster_ids" not in rows.columns and "task_cluster_ids" not in store.read("jobs_assessed").columns
    found = {r.job_id: json.loads(r.findings) for r in rows.collect()}
    assert found == {1: ["not supported DBR: 10.0", "not supported DBR: 9.1"], 2: [], 3: []}
    spark.sql("DROP DATABASE stored_jobs CASCADE")


def test_a_small_lookup_is_joined_as_it_is(spark, tmp_path):
    facts = stored(spark, tmp_path, "jobs", INVENTORIES)
    lookup = kept.kept(spark.createDataFrame([(1, "v", 3)], "job_id bigint, found string, n bigint"), "small")
    df = skew.left_join_hot_apart(facts, lookup, "job_id", "found", "n", 3)
    assert plan(df, "simple").count("Join") == 1 and df.columns == [*facts.columns, "found"]


def test_locations_are_spread_before_they_are_cut(spark, shuffled, tmp_path):
    locations = spark.createDataFrame([(f"dbfs:/vol/n{i}/t", 1) for i in range(50)], "location string, n bigint")
    locations.coalesce(1).write.parquet(str(tmp_path / "locations"))
    mounts = spark.createDataFrame([(f"/vol/n{i}/", "s") for i in range(0, 50, 2)], "mountPoint string, source string")
    mounted = storage._mounted(spark.read.parquet(str(tmp_path / "locations")), mounts)
    assert "REPARTITION_BY_NUM" in plan(mounted)
    assert {r.location for r in mounted.collect()} == {f"dbfs:/vol/n{i}/t" for i in range(0, 50, 2)}
