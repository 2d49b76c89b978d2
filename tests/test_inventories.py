from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatescope.functions.text import is_json
from estatescope.operators import inventory, metadata
from estatescope.plans import build_inventories
from estatescope.sources import (
    combine_exports,
    origin_of,
    readable_records,
    empty_dataset,
    read_metadata,
    read_payloads,
    read_records,
    unreadable_records,
)
from estatescope.sources.schemas import INVENTORIES, METADATA, RECORDS


def payloads(spark, *records):
    rows = [(r if isinstance(r, str) else json.dumps(r),) for r in records]
    return spark.createDataFrame(rows, "payload string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_clusters(spark):
    raw = payloads(
        spark,
        {"cluster_id": "c", "spark_version": " 9.1", "data_security_mode": "X", "policy_id": "p"},
        {"cluster_id": "d", "data_security_mode": ""},
    )
    assert rows(inventory.clusters_inventory(raw)) == [
        ("c", " 9.1", "X", "p"),
        ("d", None, None, None),
    ]


@pytest.mark.parametrize(
    "definition,want",
    [
        ('{"spark_version":{"value":"11.3.x"}}', "11.3.x"),
        ('{"spark_version":{"type":"unlimited"}}', None),
        ('{"spark_version":"10.4.x"}', None),
        ('{"spark_version":null}', None),
        ('{"spark_version":[{"value":"9"}]}', None),
        ('[{"spark_version":{"value":"9"}}]', None),
        ("null", None),
        ("not json", None),
        ("", None),
        (None, None),
    ],
)
def test_policy_version(spark, definition, want):
    raw = spark.createDataFrame([("p", "n", definition)], RECORDS["cluster_policies"])
    assert rows(inventory.cluster_policies_inventory(raw)) == [("p", "n", want)]


def test_jobs(spark):
    def job_cluster(version):
        return {"new_cluster": {"spark_version": version} if version is not None else {}}

    raw = payloads(
        spark,
        {
            "job_id": 1,
            "creator_user_name": "u",
            "settings": {
                "name": "n",
                "job_clusters": [job_cluster(v) for v in ("b", "a", "b", "", None)],
                "tasks": [{"task_key": "t", "existing_cluster_id": "c"}, {"job_cluster_key": "k"}],
            },
        },
        {"job_id": 2, "settings": {"name": "n", "tasks": []}},
        {"job_id": 3, "creator_user_name": "u"},
    )
    got = rows(inventory.jobs_inventory(raw))
    assert got[0][:4] == (1, "n", "u", ["b", "a"])
    assert json.loads(got[0][4]) == [
        {"task_key": "t", "existing_cluster_id": "c", "job_cluster_key": None},
        {"task_key": None, "existing_cluster_id": None, "job_cluster_key": "k"},
    ]
    assert got[1:] == [(2, "n", None, [], "[]"), (3, None, "u", [], "[]")]


def test_pipelines(spark):
    raw = payloads(
        spark,
        {
            "pipeline_id": "1",
            "name": "outer",
            "spec": {"name": "inner", "clusters": [{"label": "d", "custom_tags": {"a": "b"}}]},
        },
        {"pipeline_id": "2", "name": "outer", "spec": {"catalog": "c"}},
        {"pipeline_id": "3", "name": "outer"},
    )
    got = rows(inventory.pipelines_inventory(raw))
    assert [(g[0], g[1], g[4]) for g in got] == [("1", "inner", None), ("2", "outer", "c"), ("3", "outer", None)]
    assert json.loads(got[0][5]) == [{"label": "d", "node_type_id": None, "custom_tags": {"a": "b"}}]
    assert [g[5] for g in got[1:]] == ["[]", "[]"]


def test_submit_runs_window_and_type(spark):
    def run(i, start, kind="SUBMIT_RUN"):
        return {"run_id": i, "run_type": kind, "start_time": start, "state": {"result_state": "S"}}

    day = 86_400_000
    raw = payloads(spark, run(1, 10 * day), run(2, 8 * day), run(3, 8 * day - 1), run(4, 10 * day, "JOB_RUN"), {"run_id": 5, "run_type": "SUBMIT_RUN"})
    got = rows(inventory.submit_runs_inventory(raw, as_of_ms=10 * day, lookback_days=2))
    assert sorted(g[0] for g in got) == [1, 2]
    assert {g[4:] for g in got} == {(None, "S")}


def test_flags_default_to_false(spark):
    raw = payloads(spark, {"name": "a", "read_only": True}, {"name": "b"})
    assert [r.read_only for r in inventory.external_locations_inventory(raw).collect()] == [True, False]
    raw = payloads(spark, {"script_id": "a", "enabled": True}, {"script_id": "b", "name": "n"})
    assert rows(inventory.init_scripts_inventory(raw)) == [("a", None, None, True), ("b", "n", None, False)]


def test_grants(spark):
    def grant(payload, database="main.s", level="SCHEMA"):
        return (database, level, payload if isinstance(payload, str) else json.dumps(payload))

    raw = spark.createDataFrame(
        [
            grant({"Principal": "a", "principal": "b", "ActionType": "X"}),
            grant({"Principal": "", "principal": "b", "action_type": "Y"}),
            grant({"Principal": None, "principal": ""}),
            grant("broken"),
            grant({"Principal": "a"}, level="TABLE"),
            grant({"Principal": "a"}, database="system.s"),
        ],
        METADATA["grants"],
    )
    got = rows(metadata.grants_inventory(raw))
    assert {g[:3] for g in got} == {("main.s", "SCHEMA", "main.s")}
    assert [g[3:] for g in got] == [("a", "X"), ("b", "Y"), ("", None), (None, None)]


def test_udfs_first_rule_per_row_and_last_row_per_field(spark):
    def row(ordinal, name, value, function="f", schema="main.s", error=None):
        return (schema, function, ordinal, name, value, error)

    raw = spark.createDataFrame(
        [
            row(1, " SIGNATURE ", " x int "),
            row(2, "Deterministic body", "yes"),
            row(3, "Body", "first"),
            row(4, "Expression", "second"),
            row(5, "Returns", "int"),
            row(6, "Return Type", "bigint"),
            row(7, "Owner", "me"),
            row(1, "Owner", "me", function="g"),
            row(1, None, None, function="h", error="denied"),
            row(2, "Body", "kept back", function="h"),
            row(1, "Body", "x", schema="system.s"),
            row(10, "body", "late", function="i"),
            row(9, "body", "early", function="i"),
        ],
        METADATA["udf_info"],
    )
    listed = raw.select("schema_name", "function_name").union(
        spark.createDataFrame([("main.s", "j"), ("main.s", "j"), ("system.s", "k")], METADATA["udf_list"])
    )
    listed = listed.where("function_name <> 'i' OR schema_name = 'system.s'").union(
        spark.createDataFrame([("main.s", "i")], METADATA["udf_list"])
    )
    nothing = [("main.s", n, None, None, None, None, None) for n in "fghij"]
    assert sorted(rows(metadata.udfs_inventory(listed))) == nothing
    got = sorted(rows(metadata.udfs_inventory(listed, raw)))
    assert got == [
        ("main.s", "f", "x int", "bigint", "yes", "second", None),
        ("main.s", "g", None, None, None, None, None),
        ("main.s", "h", None, None, None, None, "denied"),
        ("main.s", "i", None, None, None, "late", None),
        ("main.s", "j", None, None, None, None, None),
    ]


def details_frame(spark, rows_, partitions="string"):
    schema = METADATA["table_details"].replace("partition_columns string", f"partition_columns {partitions}")
    return spark.createDataFrame(rows_, schema)


def test_tables(spark):
    listed = spark.createDataFrame(
        [("main.s", t) for t in "abcdefg"] + [("system.s", "a"), ("main.", "a")], METADATA["table_list"]
    )
    types = spark.createDataFrame(
        [("main", "s", "a", "MANAGED"), ("main", "s", "b", "VIEW"), ("main", "s", "c", "view"), ("main", "s", "e", "EXTERNAL"),
         ("main", "s", "a", "MANAGED"), ("other", "s", "d", "VIEW")],
        METADATA["table_types"],
    )
    details = details_frame(
        spark,
        [
            ("main.s", "a", "delta", "l", 5, '["p"]', None),
            ("main.s", "a", "delta", "l", 5, '["p"]', None),
            ("main.s", "b", "delta", "l", 5, '["p"]', "x"),
            ("main.s", "c", "DELTA", "l", None, "", None),
            ("main.s", "e", "delta", "l", 5, '["p"]', "denied"),
            ("main.s", "f", None, None, 7, None, None),
        ],
    )
    got = {r[1]: tuple(r)[2:] for r in metadata.tables_inventory(listed, types, details).collect()}
    assert got == {
        "a": ("MANAGED", "delta", "l", 5, True, '["p"]', None),
        "b": ("VIEW", None, None, 0, False, "[]", None),
        "c": ("view", "DELTA", "l", None, False, "[]", None),
        "d": ("UNKNOWN", None, None, 0, False, "[]", None),
        "e": ("EXTERNAL", None, None, 0, False, "[]", "denied"),
        "f": ("UNKNOWN", None, None, 7, False, "[]", None),
        "g": ("UNKNOWN", None, None, 0, False, "[]", None),
    }


def test_rows_landed_twice_are_one_table(spark):
    listed = spark.createDataFrame([("main.s", "a")] * 50, METADATA["table_list"])
    types = spark.createDataFrame([("main", "s", "a", "MANAGED")] * 50, METADATA["table_types"])
    details = details_frame(spark, [("main.s", "a", "csv", "l", 1, "[]", None)] * 50)
    assert metadata.tables_inventory(listed, types, details).count() == 1


def test_partition_lists_become_json(spark):
    listed = spark.createDataFrame([("main.s", "a"), ("main.s", "b")], METADATA["table_list"])
    types = spark.createDataFrame([], METADATA["table_types"])
    details = details_frame(
        spark,
        [("main.s", "a", "csv", "l", 1, ["x", "y"], None), ("main.s", "b", "csv", "l", 1, [], None)],
        "array<string>",
    )
    got = {r.table: r.partition_columns for r in metadata.tables_inventory(listed, types, details).collect()}
    assert got == {"a": '["x","y"]', "b": "[]"}


def test_accessible_schemas(spark):
    schemas = spark.createDataFrame(
        [("main", "s"), ("main", "s"), ("system", "s"), ("main", ""), (None, "s"), ("main", None)],
        "table_catalog string, table_schema string",
    )
    assert rows(metadata.accessible_schemas(schemas)) == [("main.s",)]
    assert rows(metadata.accessible_schemas(schemas, ["main", "system"])) == [("main.s",)]
    assert rows(metadata.accessible_schemas(schemas, ["other", "system"])) == []


def test_every_inventory_has_its_declared_schema_on_empty_input(spark):
    landed = {k: spark.createDataFrame([], s) for k, s in RECORDS.items()}
    landed |= {k: spark.createDataFrame([], s) for k, s in METADATA.items()}
    for name, df in build_inventories(landed, as_of_ms=0).items():
        want = empty_dataset(spark, name)
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in want.schema], name
        assert df.count() == 0
    assert set(INVENTORIES) == set(build_inventories({}, as_of_ms=0))
    assert set(build_inventories({}, as_of_ms=0).values()) == {None}


def test_typed_records_and_raw_payloads_give_the_same_inventories(spark, tmp_path):
    records = [
        {"job_id": 1, "settings": {"name": "n", "job_clusters": [{"new_cluster": {"spark_version": "9.1"}}]}, "extra": {"x": 1}},
        {"job_id": 2, "creator_user_name": "u", "settings": {"tasks": [{"task_key": "t"}]}},
    ]
    (tmp_path / "jobs.json").write_text("\n".join(json.dumps(r) for r in records))
    path = str(tmp_path / "jobs.json")
    typed = inventory.jobs_inventory(read_records(spark, "jobs", path))
    raw = inventory.jobs_inventory(read_payloads(spark, path))
    assert rows(typed) == rows(raw)
    assert len(rows(raw)) == 2
    run = {"run_id": 1, "run_type": "SUBMIT_RUN", "start_time": 5, "state": {"life_cycle_state": "L"}}
    (tmp_path / "runs.json").write_text(json.dumps(run))
    path = str(tmp_path / "runs.json")
    typed = inventory.submit_runs_inventory(read_records(spark, "submit_runs", path), 5)
    raw = inventory.submit_runs_inventory(read_payloads(spark, path), 5)
    assert rows(typed) == rows(raw) == [(1, None, None, 5, "L", None)]


def test_metadata_reader_and_combined_exports(spark, tmp_path):
    first = spark.createDataFrame([("/mnt/a", "s")], METADATA["mounts"])
    first.write.parquet(str(tmp_path / "a"))
    one = read_metadata(spark, "mounts", str(tmp_path / "a"))
    both = combine_exports(one, first.select("mount_point"), origins=["w1", "w1"])
    assert set(rows(both)) == {("/mnt/a", "s"), ("/mnt/a", None)}
    assert both.schema["source"].dataType == T.StringType()


def test_exports_of_two_workspaces_are_refused(spark):
    one = spark.createDataFrame([("/mnt/a", "s")], METADATA["mounts"])
    assert combine_exports(one, one, origins=["w1", "w1"]).count() == 2
    with pytest.raises(ValueError, match="several workspaces"):
        combine_exports(one, one, origins=["w1", "w2"])
    with pytest.raises(ValueError, match="is not known"):
        combine_exports(one, one)
    with pytest.raises(ValueError, match="is not known"):
        combine_exports(one, one, origins=["w1", None])
    with pytest.raises(ValueError, match="1 origins"):
        combine_exports(one, one, origins=["w1"])
    with pytest.raises(ValueError, match="no exports"):
        combine_exports()
    assert combine_exports(one).count() == 1


def test_origins_are_read_from_paths(spark, tmp_path):
    one = spark.createDataFrame([("/mnt/a", "s")], METADATA["mounts"])
    for place in ("x/workspace=w1/mounts", "y/workspace=w1/mounts", "workspace=w2/mounts", "mounts"):
        one.write.parquet(f"{tmp_path}/{place}")
    read = lambda *places: read_metadata(spark, "mounts", *(f"{tmp_path}/{p}" for p in places))
    first, again, other, none = map(read, ("x/workspace=w1/mounts", "y/workspace=w1/mounts", "workspace=w2/mounts", "mounts"))
    assert origin_of(first) == "w1" and origin_of(none) is None
    assert combine_exports(first, again).count() == 2
    for refused in ([first, other], [first, none], [read("x/workspace=w1/mounts", "workspace=w2/mounts"), again]):
        with pytest.raises(ValueError, match="workspace"):
            combine_exports(*refused)


def test_only_possible_submit_runs_are_parsed(spark):
    """Text without the run type's name, or an escape that could spell it, never reaches the parser."""
    run = {"run_id": 1, "run_type": "SUBMIT_RUN", "start_time": 5}
    texts = [
        json.dumps(run), json.dumps({**run, "run_id": 2, "run_type": "JOB_RUN"}), json.dumps({**run, "run_id": 3}).replace("SUBMIT_RUN", "SUBMIT\\u005fRUN"),
        json.dumps({**run, "run_id": 4, "run_type": "JOB_RUN", "run_name": "SUBMIT_RUN"}), json.dumps({**run, "run_id": 5, "run_type": "WORKFLOW_RUN"}), None,
    ]
    raw = spark.createDataFrame([(t,) for t in texts], "payload string")
    assert inventory.possible_submit_runs(raw).count() == 3
    assert sorted(r.run_id for r in inventory.submit_runs_inventory(raw, 5).collect()) == [1, 3]


def test_counting_parses_one_field(spark, tmp_path):
    texts = ['{"job_id": 1, "settings": {"name": "n"}}', '{"settings": {"name": "n"}}', '{"job_id": "x", "creator_user_name": "u"}', "{}", '{"job_id": 2, "sett', "[1]", "", "null"]
    raw = spark.createDataFrame([(t,) for t in texts], "payload string")
    counted = readable_records(raw, "jobs")
    assert counted.columns == ["job_id"] and counted.count() == inventory.jobs_inventory(raw).count() == 4


def test_broken_and_blank_lines_are_no_objects(spark, tmp_path):
    path = str(tmp_path / "jobs.json")
    good = '{"job_id": 1, "settings": {"name": "n"}}'
    (tmp_path / "jobs.json").write_text("\n".join([good, "", "  ", '{"job_id": 2, "sett', "null", "[1]", "{}", '{"job_id": "x", "creator_user_name": "u"}']))
    typed, raw = read_records(spark, "jobs", path), read_payloads(spark, path)
    want = [(1, "n", None), (None, None, None), (None, None, "u")]
    for source in (typed, raw):
        got = inventory.jobs_inventory(source).select("job_id", "job_name", "creator").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.text for r in unreadable_records(raw, "jobs").collect()} == {'{"job_id": 2, "sett', "[1]"}
    assert {r.kind for r in unreadable_records(raw, "jobs").collect()} == {"jobs"}


@pytest.mark.parametrize("have", [(), ("types",), ("details",)])
def test_tables_are_listed_whatever_lookup_is_missing(spark, have):
    listed = spark.createDataFrame([("main.a", "t"), ("main.a", "u")], METADATA["table_list"])
    given = {
        "types": spark.createDataFrame([("main", "a", "t", "EXTERNAL")], METADATA["table_types"]),
        "details": details_frame(spark, [("main.a", "t", "delta", "s3://b", 7, "[]", None)]),
    }
    got = {r.table: (r.table_type, r.format, r.size) for r in metadata.tables_inventory(listed, **{k: given[k] for k in have}).collect()}
    kind = "EXTERNAL" if "types" in have else "UNKNOWN"
    assert got == {"t": (kind, "delta", 7) if "details" in have else (kind, None, 0), "u": ("UNKNOWN", None, 0)}


def test_json_is_taken_whole(spark):
    texts = {'{"a":1}': True, ' [1] ': True, '"x"': True, "null": True, "1": True, '{"a":1} x': False, '{"a":1': False,
             "": False, " ": False, "1, 2": False, '{"a":1}],[{"b":2}': False, "1} x": False, "a": False, None: False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.ok for r in df.select("t", is_json(F.col("t")).alias("ok")).collect()} == texts


def test_only_whitespace_and_null_are_no_records(spark):
    white = " \t\n\r\x0b\x0c"
    blank = ["", " ", white, "null", f"{white}null{white}", white * 500, f"null{white * 500}", None]
    others = ["nul", "null null", "Null", "null\u00a0", "\u2028", "null\u0085", '{"job_id": 1}', f"{white}[1]", "x"]
    raw = spark.createDataFrame([(t,) for t in blank + others], "payload string")
    texts = [r.text for r in unreadable_records(raw, "jobs").collect()]
    assert sorted(texts) == sorted(t for t in others if t != '{"job_id": 1}')
    assert [r.job_id for r in inventory.jobs_inventory(raw).collect()] == [1]
