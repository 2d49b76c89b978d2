"""Registered queries: each runs one operator over whole landed inputs.

Lists leave as text joined with ``; ``, because array values are compared as text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.landed_sql import AS_OF_MS, LANDED, landed
from estatescope.operators import inventory, metadata, rollups, rules, storage
from estatescope.operators.kept import kept
from estatescope.plans import assess, build_inventories, countable, run_assessment, store_table_parts, stored_tables
from estatescope.sinks import REPORT_TABLES, SnapshotStore
from estatescope.sinks.snapshots import STAMP
from estatescope.sources import combine_exports, read_metadata, read_payloads, read_records, unreadable_records

Query = Callable[[SparkSession, str], DataFrame]


def _list_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "; ") for c in columns})


def _shared_folder(spark: SparkSession, purpose: str) -> str:
    """A folder for written tables that all executors share: under the one the cluster names
    for checkpoints, else under the warehouse. One root per session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/estatescope/{spark.conf.get('spark.app.id')}/{purpose}"


# Inventories


def clusters_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.clusters_inventory(landed(spark, sf_dir, "clusters"))


def cluster_policies_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.cluster_policies_inventory(landed(spark, sf_dir, "cluster_policies"))


def jobs_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list_text(inventory.jobs_inventory(landed(spark, sf_dir, "jobs")), "dbr_versions")


def pipelines_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.pipelines_inventory(landed(spark, sf_dir, "pipelines"))


def submit_runs_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.submit_runs_inventory(landed(spark, sf_dir, "submit_runs"), AS_OF_MS)


def external_locations_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.external_locations_inventory(landed(spark, sf_dir, "external_locations"))


def init_scripts_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.init_scripts_inventory(landed(spark, sf_dir, "global_init_scripts"))


def grants_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.grants_inventory(landed(spark, sf_dir, "grants"))


def mounts_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.mounts_inventory(landed(spark, sf_dir, "mounts"))


def udfs_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.udfs_inventory(
        landed(spark, sf_dir, "udf_list"), landed(spark, sf_dir, "udf_info")
    )


def tables_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.tables_inventory(
        landed(spark, sf_dir, "table_list"),
        landed(spark, sf_dir, "table_types"),
        landed(spark, sf_dir, "table_details"),
    )


def accessible_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.accessible_schemas(landed(spark, sf_dir, "schemas"))


def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated records, which no inventory lists."""
    kinds = ("clusters", "jobs", "submit_runs")
    return reduce(
        DataFrame.unionByName, [unreadable_records(landed(spark, sf_dir, k), k) for k in kinds]
    )


def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs written as files, with blank lines, and read back by each reader."""
    root = _shared_folder(spark, "landed_files")
    for kind in ("clusters", "jobs"):
        # Each record is followed by a blank line and a null.
        lines = landed(spark, sf_dir, kind).select(F.concat("payload", F.lit("\n\nnull")))
        lines.write.mode("overwrite").text(f"{root}/{kind}")
    landed(spark, sf_dir, "mounts").write.mode("overwrite").parquet(f"{root}/mounts")
    clusters = inventory.clusters_inventory(read_records(spark, "clusters", f"{root}/clusters"))
    jobs = inventory.jobs_inventory(read_payloads(spark, f"{root}/jobs"))
    mounts = metadata.mounts_inventory(read_metadata(spark, "mounts", f"{root}/mounts"))
    parts = (("clusters", clusters, "cluster_id", "spark_version"), ("mounts", mounts, "mountPoint", "source"), ("jobs", jobs, "job_id", "job_name"))
    return reduce(
        DataFrame.unionByName,
        [
            df.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.col(detail).alias("detail"))
            for kind, df, name, detail in parts
        ],
    )


def combined_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports of one workspace as files, one of them without sources; the workspace is in their paths."""
    root = _shared_folder(spark, "combined_exports")
    paths = [f"{root}/{crawl}/workspace=w1/mounts" for crawl in ("first", "second")]
    for name, path in zip(("mounts", "old_mounts"), paths):
        landed(spark, sf_dir, name).write.mode("overwrite").parquet(path)
    exports = read_metadata(spark, "mounts", paths[0]), spark.read.schema("mount_point string").parquet(paths[1])
    return metadata.mounts_inventory(combine_exports(*exports))


# Rules


def _clusters_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess_clusters(clusters_inventory(spark, sf_dir))


def _tables_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess_tables(tables_inventory(spark, sf_dir))


def _jobs_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rules read an inventory as it is stored, here as in the whole assessment.
    jobs = kept(inventory.jobs_inventory(landed(spark, sf_dir, "jobs"), keep_tasks=True), "jobs")
    return rules.assess_jobs(jobs.rows, _clusters_assessed(spark, sf_dir)).drop("tasks")


def _assessed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "clusters": _clusters_assessed(spark, sf_dir),
        "jobs": _jobs_assessed(spark, sf_dir),
        "tables": _tables_assessed(spark, sf_dir),
    }


def unsupported_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unsupported_versions(clusters_inventory(spark, sf_dir))


def disallowed_access_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.disallowed_access_modes(clusters_inventory(spark, sf_dir))


def clusters_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list_text(_clusters_assessed(spark, sf_dir), "findings")


def tables_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list_text(_tables_assessed(spark, sf_dir), "findings")


def jobs_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list_text(_jobs_assessed(spark, sf_dir), "dbr_versions", "findings")


def storage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = storage.storage_classes(
        tables_inventory(spark, sf_dir), mounts_inventory(spark, sf_dir)
    )
    return classes.select("catalog_schema", "table", "location", "storage_type")


# Rollups


def storage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.storage_summary(
        tables_inventory(spark, sf_dir), mounts_inventory(spark, sf_dir)
    )


def grants_by_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.grants_by_database(grants_inventory(spark, sf_dir))


def database_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.database_summary(
        _tables_assessed(spark, sf_dir), grants_inventory(spark, sf_dir)
    )


def _assessed_once(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict]:
    """As ``_assessed``, with the jobs written and their tally measured on the way."""
    assessed = _assessed(spark, sf_dir)
    jobs = kept(assessed["jobs"], "jobs-assessed", **rollups.tally())
    return {**assessed, "jobs": jobs.rows}, {"jobs": jobs.metrics}


def readiness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.readiness_summary(spark, *_assessed_once(spark, sf_dir))


def assessment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.assessment_summary(spark, _assessed_once(spark, sf_dir)[0])


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.overview(spark, countable({n: landed(spark, sf_dir, n) for n in LANDED}))


def partial_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only tables were landed: the other inventories are empty datasets, assessed like any."""
    names = ("table_list", "table_types", "table_details")
    inventories = build_inventories({n: landed(spark, sf_dir, n) for n in names}, AS_OF_MS)
    assessed = assess(spark, inventories)
    readiness = rollups.readiness_summary(spark, assessed).withColumnRenamed("readiness", "value")
    sizes = (
        df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("object_type"), "value")
        for name, df in assessed.items()
    )
    parts = [readiness.withColumn("metric", F.lit("readiness"))]
    return reduce(DataFrame.unionByName, [*parts, *(s.withColumn("metric", F.lit("objects")) for s in sizes)])


# Stored tables and the report


def _store(spark: SparkSession, key: str) -> SnapshotStore:
    """A store of its own per query: tables ``estatescope_<key>.<name>`` in the shared folder."""
    schema, root = f"estatescope_{key}", _shared_folder(spark, key)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema} LOCATION '{root}'")
    return SnapshotStore(spark, schema=schema, root=root)


def snapshot_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _store(spark, "snapshot_write").write("clusters", clusters_inventory(spark, sf_dir))
    return stored.where(F.col(STAMP).isNotNull()).drop(STAMP)


def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, "snapshot_read")
    store.write("udfs", udfs_inventory(spark, sf_dir))
    return store.read("udfs").drop(STAMP)


def materialize_or_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refreshed first; the second call then reads what is stored and does not build."""
    store = _store(spark, "materialize_or_read")
    store.materialize_or_read("tables", lambda: tables_inventory(spark, sf_dir), force_refresh=True)

    def unexpected() -> DataFrame:
        raise AssertionError("a stored table was built again")

    return store.materialize_or_read("tables", unexpected).drop(STAMP)


def stored_table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table inventory of parts that are stored in buckets."""
    store = _store(spark, "stored_table_parts")
    store_table_parts(store, {n: landed(spark, sf_dir, n) for n in ("table_list", "table_types", "table_details")})
    return stored_tables(store)


def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole assessment, stored and written, then read back.

    Rows of each report table, and the sum of 32 bits of each row's hash as JSON text:
    it does not depend on the order of rows, and a changed or swapped cell changes it.
    """
    folders = run_assessment(
        spark,
        {n: landed(spark, sf_dir, n) for n in LANDED},
        _store(spark, "report_tables"),
        _shared_folder(spark, "report"),
        AS_OF_MS,
        force_refresh=True,
    )

    def summed(place: int, title: str, name: str) -> DataFrame:
        rows = spark.read.parquet(folders[name]).drop(STAMP)
        text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        digest = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
        return rows.agg(
            F.count("*").alias("row_count"),
            F.coalesce(F.sum(digest), F.lit(0)).cast("long").alias("row_hash_sum"),
        ).select(F.lit(place).alias("place"), F.lit(title).alias("title"), "row_count", "row_hash_sum")

    parts = [summed(i, title, name) for i, (title, name) in enumerate(REPORT_TABLES, start=1)]
    return reduce(DataFrame.unionByName, parts)


QUERIES: dict[str, Query] = {
    "snapshot_write": snapshot_write,
    "snapshot_read": snapshot_read,
    "materialize_or_read": materialize_or_read,
    "report_tables": report_tables,
    "clusters_inventory": clusters_inventory,
    "cluster_policies_inventory": cluster_policies_inventory,
    "jobs_inventory": jobs_inventory,
    "pipelines_inventory": pipelines_inventory,
    "submit_runs_inventory": submit_runs_inventory,
    "external_locations_inventory": external_locations_inventory,
    "init_scripts_inventory": init_scripts_inventory,
    "grants_inventory": grants_inventory,
    "mounts_inventory": mounts_inventory,
    "udfs_inventory": udfs_inventory,
    "tables_inventory": tables_inventory,
    "accessible_schemas": accessible_schemas,
    "unreadable_records": unreadable,
    "landed_files": landed_files,
    "combined_exports": combined_exports,
    "stored_table_parts": stored_table_parts,
    "unsupported_versions": unsupported_versions,
    "disallowed_access_modes": disallowed_access_modes,
    "clusters_assessed": clusters_assessed,
    "tables_assessed": tables_assessed,
    "jobs_assessed": jobs_assessed,
    "storage_classes": storage_classes,
    "storage_summary": storage_summary,
    "grants_by_database": grants_by_database,
    "database_summary": database_summary,
    "readiness_summary": readiness_summary,
    "assessment_summary": assessment_summary,
    "overview": overview,
    "partial_readiness": partial_readiness,
}
