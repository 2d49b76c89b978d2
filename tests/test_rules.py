from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from estatescope.functions.versions import version_pair
from estatescope.operators import rules, skew
from estatescope.operators.inventory import jobs_inventory
from estatescope.sources.schemas import INVENTORIES

OLD = "not supported DBR: "


def clusters(spark, *rows):
    return spark.createDataFrame(list(rows), INVENTORIES["clusters"] + ", findings array<string>")


def job(i, versions=(), ids=(), text=None, name="n"):
    tasks = text if text is not None else json.dumps([{"existing_cluster_id": c} for c in ids])
    return (i, name, "u", list(versions) if versions is not None else None, tasks)


def jobs(spark, *rows):
    return spark.createDataFrame(list(rows), INVENTORIES["jobs"])


def found(df):
    return {r.job_id: r.findings for r in df.collect()}


def test_assess_clusters(spark):
    df = spark.createDataFrame(
        [
            ("a", "9.1.x", "NO_ISOLATION", None),
            ("b", "11.3.x", "LEGACY_SINGLE_USER", None),
            ("c", "10.4", "USER_ISOLATION", None),
            ("d", None, None, None),
        ],
        INVENTORIES["clusters"],
    )
    got = {r.cluster_id: r.findings for r in rules.assess_clusters(df).collect()}
    assert got == {
        "a": [OLD + "9.1.x", "No isolation shared clusters not supported in UC"],
        "b": ["cluster type not supported : LEGACY_SINGLE_USER"],
        "c": [OLD + "10.4"],
        "d": [],
    }
    flagged = [tuple(r) for r in rules.unsupported_versions(df).collect()]
    assert flagged == [("a", "9.1.x", OLD + "9.1.x"), ("c", "10.4", OLD + "10.4")]
    assert [r.cluster_id for r in rules.disallowed_access_modes(df).collect()] == ["a", "b"]
    assert rules.assess_clusters(df, None, None).where(F.size("findings") > 0).count() == 0


def test_assess_tables(spark):
    def table(name, kind, fmt, location):
        return ("main.s", name, kind, fmt, location, 0, False, "[]", None)

    df = spark.createDataFrame(
        [
            table("a", "view", "csv", "dbfs:/x"),
            table("b", "MANAGED", "Parquet", "/mnt/x"),
            table("c", "MANAGED", "DELTA", "dbfs:/x"),
            table("d", None, None, None),
            table("e", "EXTERNAL", "", "file:/dbfs/x"),
        ],
        INVENTORIES["tables"],
    )
    got = {r.table: r.findings for r in rules.assess_tables(df).collect()}
    assert got == {
        "a": [],
        "b": ["Non-DELTA format: PARQUET", "Data is in DBFS Mount"],
        "c": ["Data is in DBFS Root"],
        "d": [],
        "e": [],
    }


def test_assess_jobs_order_and_repeats(spark):
    known = clusters(
        spark,
        ("a", None, None, None, [OLD + "9.1", "mode"]),
        ("b", None, None, None, ["other", "mode"]),
        ("clean", None, None, None, []),
        (None, None, None, None, ["never"]),
    )
    df = jobs(
        spark,
        job(1, ["10.4", "9.1", "11.3"], ["b", "a"]),
        job(2, [], ["a", "b", "a"]),
        job(3, [], ["clean", "gone", None]),
        job(4, None, []),
        job(5, ["9.1"], text="[{not json"),
        job(6, [], text=None, ids=[None]),
        (7, None, None, None, None),
        job(8, ["9.1"], text=""),
    )
    assert found(rules.assess_jobs(df, known)) == {
        1: [OLD + "10.4", OLD + "9.1", "other", "mode"],
        2: [OLD + "9.1", "mode", "other"],
        3: [],
        4: [],
        5: [OLD + "9.1"],
        6: [],
        7: [],
        8: [OLD + "9.1"],
    }
    assert rules.assess_jobs(df, known).columns == [*df.columns, "findings"]


def test_kept_tasks_and_task_text_give_the_same(spark):
    records = [
        {"job_id": 1, "settings": {"tasks": [{"existing_cluster_id": "b"}, {"task_key": "t"}, {"existing_cluster_id": "a"}]}},
        {"job_id": 2, "settings": {"tasks": []}},
        {"job_id": 3},
    ]
    raw = spark.createDataFrame([(json.dumps(r),) for r in records], "payload string")
    known = clusters(spark, ("a", None, None, None, ["x", "y"]), ("b", None, None, None, ["y"]))
    want = {1: ["y", "x"], 2: [], 3: []}
    assert found(rules.assess_jobs(jobs_inventory(raw), known)) == want
    kept = rules.assess_jobs(jobs_inventory(raw, keep_tasks=True), known)
    assert found(kept) == want
    assert kept.columns[-2:] == ["tasks", "findings"]


def test_assess_jobs_without_clusters(spark):
    df = jobs(spark, job(1, ["9.1", "9.1"], ["a"]))
    assert found(rules.assess_jobs(df, None)) == {1: [OLD + "9.1"]}
    assert found(rules.assess_jobs(df, clusters(spark).limit(0))) == {1: [OLD + "9.1"]}


def test_repeated_cluster_ids_give_the_union(spark):
    known = clusters(
        spark,
        ("a", None, None, None, ["x", "y"]),
        ("a", None, None, None, ["x", "z"]),
        ("a", None, None, None, []),
    )
    assert found(rules.assess_jobs(jobs(spark, job(1, [], ["a"])), known)) == {1: ["x", "y", "z"]}


def test_equal_jobs_stay_apart(spark):
    known = clusters(spark, ("a", None, None, None, ["x"]))
    df = jobs(spark, *[job(1, [], ["a"])] * 7)
    got = rules.assess_jobs(df, known).collect()
    assert [r.findings for r in got] == [["x"]] * 7


def brute_force(job_rows, cluster_rows):
    by_id = {c[0]: c[4] for c in cluster_rows}
    result = {}
    for i, _, _, versions, text in job_rows:
        out = [OLD + v for v in versions if tuple(map(int, v.split("."))) < (11, 3)]
        for task in json.loads(text):
            out += by_id.get(task["existing_cluster_id"], [])
        result[i] = list(dict.fromkeys(out))
    return result


def test_one_cluster_and_one_list_hold_a_third_of_the_jobs(spark, shuffled):
    rng = random.Random(7)
    cluster_rows = [
        (f"c{i}", None, None, None, rng.sample(["p", "q", "r", "s"], rng.randint(0, 3)))
        for i in range(40)
    ]
    ids = [c[0] for c in cluster_rows] + ["gone"]
    job_rows = []
    for i in range(3000):
        share = i % 3
        if share == 0:
            picked = ["c0"]
        elif share == 1:
            picked = ["c0", rng.choice(ids)]
        else:
            picked = rng.choices(ids, k=rng.randint(0, 4))
        job_rows.append(job(i, rng.sample(["9.1", "10.4", "11.3", "14.3"], rng.randint(0, 3)), picked))
    df = jobs(spark, *job_rows).repartition(6)
    assert found(rules.assess_jobs(df, clusters(spark, *cluster_rows))) == brute_force(job_rows, cluster_rows)


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_hot_apart_join_equals_a_left_join(spark, shuffled, partitions):
    keys = ["hot"] * 400 + ["healthy"] * 400 + ["warm"] * 100 + [f"k{i}" for i in range(200)] + [None] * 400
    facts = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").repartition(5)
    held = {"hot": "H", "warm": "W", **{f"k{i}": f"v{i}" for i in range(0, 200, 2)}}
    known = [(k, held.get(k), keys.count(k)) for k in set(keys) if k is not None]
    lookup = spark.createDataFrame(known, "k string, v string, n int")
    got = skew.left_join_hot_apart(facts, lookup, "k", "v", "n", partitions=partitions)
    assert {r.i: r.v for r in got.collect()} == {i: held.get(k) for i, k in enumerate(keys)}
    assert got.count() == len(keys)


def test_inner_join_with_hot_keys_equals_a_plain_join(spark, shuffled):
    facts = spark.range(0, 1000, 1, 7).select(
        "id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    lookup = spark.createDataFrame([("hot", 1), ("k3", None), ("k6", 3), ("none", 4)], "k string, v int")
    inner = skew.inner_join_hot_apart(facts, lookup, "k").select("id", "k", "v")
    assert sorted(map(str, inner.collect())) == sorted(map(str, facts.join(lookup, "k").select("id", "k", "v").collect()))
    semi = skew.inner_join_hot_apart(facts, lookup.select("k"), "k")
    assert semi.columns == ["id", "k"]
    assert sorted(semi.collect()) == sorted(facts.join(lookup, "k", "left_semi").select("id", "k").collect())


@pytest.mark.parametrize("inherits", [True, False])
def test_a_list_with_most_jobs_does_not_fill_a_partition(spark, shuffled, inherits):
    """Without help from adaptive execution, whether the list's clusters have findings or not."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        n = 8000
        rows = spark.range(0, n, 1, 16).select(
            F.when(F.col("id") % 5 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("k")
        )
        known = rows.groupBy("k").agg(F.count("*").alias("n"))
        value = F.when(F.lit(inherits) | (F.col("k") != "hot"), F.lit("x"))
        got = skew.left_join_hot_apart(rows, known.withColumn("v", value), "k", "v", "n")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) <= 2.5 * n / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_findings_are_never_null_nor_repeated(spark):
    import __spark_entry__  # noqa: F401
    from checks.queries import _assessed

    for df in _assessed(spark, "/root/testdata/sf0.001").values():
        bad = F.col("findings").isNull() | (F.size(F.array_distinct("findings")) < F.size("findings"))
        nulls = F.exists("findings", lambda f: f.isNull())
        assert df.where(bad | nulls).count() == 0


def test_version_pairs_order_by_number(spark):
    df = spark.createDataFrame([("9.10",), ("9.9",), ("10.0",)], "v string")
    assert [r.v for r in df.orderBy(version_pair(F.col("v"))).collect()] == ["9.9", "9.10", "10.0"]
