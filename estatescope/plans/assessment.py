"""The whole assessment: landed exports to inventories, findings, rollups and report."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from estatescope.operators import inventory, metadata, rollups, rules, storage
from estatescope.settings import (
    DISALLOWED_ACCESS_MODES,
    MIN_RUNTIME_VERSION,
    SUBMIT_RUN_LOOKBACK_DAYS,
)
from estatescope.sinks import SnapshotStore, write_report
from estatescope.sinks.together import run_together
from estatescope.sources import empty_dataset, readable_records
from estatescope.sources.landed import no_rows
from estatescope.sources.schemas import INVENTORIES

# Inventory name -> landed inputs it is made of. The first is what it lists and is
# needed; without one of the others the inventory has less to say.
INPUTS = {
    "clusters": ("clusters",),
    "cluster_policies": ("cluster_policies",),
    "jobs": ("jobs",),
    "pipelines": ("pipelines",),
    "submit_runs": ("submit_runs",),
    "tables": ("table_list", "table_types", "table_details"),
    "udfs": ("udf_list", "udf_info"),
    "grants": ("grants",),
    "mounts": ("mounts",),
    "external_locations": ("external_locations",),
    "global_init_scripts": ("global_init_scripts",),
}


def build_inventories(
    landed: Mapping[str, DataFrame],
    as_of_ms: int,
    lookback_days: int = SUBMIT_RUN_LOOKBACK_DAYS,
) -> dict[str, DataFrame | None]:
    """The eleven inventories; ``None`` where what they list was not landed."""
    build: dict[str, Callable[..., DataFrame]] = {
        "clusters": inventory.clusters_inventory,
        "cluster_policies": inventory.cluster_policies_inventory,
        "jobs": inventory.jobs_inventory,
        "pipelines": inventory.pipelines_inventory,
        "submit_runs": lambda raw: inventory.submit_runs_inventory(raw, as_of_ms, lookback_days),
        "tables": metadata.tables_inventory,
        "udfs": metadata.udfs_inventory,
        "grants": metadata.grants_inventory,
        "mounts": metadata.mounts_inventory,
        "external_locations": inventory.external_locations_inventory,
        "global_init_scripts": inventory.init_scripts_inventory,
    }
    return {
        name: build[name](*[landed.get(i) for i in inputs]) if inputs[0] in landed else None
        for name, inputs in INPUTS.items()
    }


def countable(landed: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """What the overview counts, straight from the exports: one field of each record that can be
    read, tables with their types, the listed functions, and mounts."""
    build: dict[str, Callable[[DataFrame], DataFrame]] = {
        "tables": lambda listed: metadata.tables_inventory(listed, landed.get("table_types")),
        "udfs": metadata.udfs_inventory,
        "mounts": metadata.mounts_inventory,
    }
    found = {name: make(landed[INPUTS[name][0]]) for name, make in build.items() if INPUTS[name][0] in landed}
    for kind in ("clusters", "jobs", "pipelines", "external_locations"):
        if kind in landed:
            raw = landed[kind]
            found[kind] = readable_records(raw, kind) if "payload" in raw.columns else raw
    return found


def store_inventories(
    store: SnapshotStore,
    inventories: Mapping[str, DataFrame | None],
    force_refresh: bool = False,
    stamped_at: str | None = None,
) -> dict[str, DataFrame | None]:
    """Each inventory as stored; what is already stored is not built again."""

    def keep(name: str, df: DataFrame | None) -> DataFrame | None:
        if df is not None:
            return store.materialize_or_read(name, lambda: df, force_refresh, stamped_at)
        return store.read(name) if not force_refresh and store.exists(name) else None

    frames = run_together(
        store.spark, [partial(keep, name, df) for name, df in inventories.items()]
    )
    return dict(zip(inventories, frames))


def assess(
    spark: SparkSession,
    inventories: Mapping[str, DataFrame | None],
    min_version: str | None = MIN_RUNTIME_VERSION,
    disallowed: Iterable[str] | None = DISALLOWED_ACCESS_MODES,
) -> dict[str, DataFrame]:
    """Clusters, jobs and tables with their findings; without rows where an inventory is missing."""

    def rows_of(name: str) -> DataFrame:
        df = inventories.get(name)
        return df if df is not None else empty_dataset(spark, name)

    clusters = rules.assess_clusters(rows_of("clusters"), min_version, disallowed)
    jobs = inventories.get("jobs")
    if jobs is None:
        assessed_jobs = no_rows(spark, f"{INVENTORIES['jobs']}, findings array<string>")
    else:
        assessed_jobs = rules.assess_jobs(jobs, clusters, min_version)
    return {
        "clusters": clusters,
        "jobs": assessed_jobs,
        "tables": rules.assess_tables(rows_of("tables")),
    }


def summarized_storage(inventories: Mapping[str, DataFrame | None]) -> DataFrame | None:
    """The storage summary; there is none without tables. What it counts is written when this is called."""
    tables = inventories.get("tables")
    return None if tables is None else storage.storage_summary(tables, inventories.get("mounts"))


def roll_up(
    spark: SparkSession,
    inventories: Mapping[str, DataFrame | None],
    assessed: Mapping[str, DataFrame],
    tallies: Mapping[str, Mapping[str, int]] | None = None,
    summarize_storage: bool = True,
) -> dict[str, DataFrame | None]:
    """The five rollups; there is no storage summary without tables.

    ``tallies`` are those that were measured while assessed inventories were stored.
    Without ``summarize_storage`` the storage summary is left to the caller.
    """
    tables = assessed["tables"]
    storage_summary = summarized_storage(inventories) if summarize_storage else None
    return {
        "readiness_summary": rollups.readiness_summary(spark, assessed, tallies),
        "assessment_summary": rollups.assessment_summary(spark, assessed),
        "database_summary": rollups.database_summary(tables, inventories.get("grants")).orderBy(
            "database"
        ),
        "storage_summary": storage_summary,
        "overview": rollups.overview(spark, inventories),
    }


def build_assessment(
    spark: SparkSession,
    inventories: Mapping[str, DataFrame | None],
    min_version: str | None = MIN_RUNTIME_VERSION,
    disallowed: Iterable[str] | None = DISALLOWED_ACCESS_MODES,
) -> dict[str, DataFrame | None]:
    """Assessed clusters, jobs and tables, and the rollups over them, as lazy plans."""
    assessed = assess(spark, inventories, min_version, disallowed)
    return {**assessed, **roll_up(spark, inventories, assessed)}


def run_assessment(
    spark: SparkSession,
    landed: Mapping[str, DataFrame],
    store: SnapshotStore,
    report_root: str,
    as_of_ms: int,
    lookback_days: int = SUBMIT_RUN_LOOKBACK_DAYS,
    min_version: str | None = MIN_RUNTIME_VERSION,
    disallowed: Iterable[str] | None = DISALLOWED_ACCESS_MODES,
    force_refresh: bool = False,
    stamped_at: str | None = None,
    fmt: str = "parquet",
) -> dict[str, str]:
    """Store the inventories, assess them as stored, and write the report.

    Findings of clusters and tables are projections of what is stored and are not stored
    again. Those of jobs take a join and feed several rollups, so they are stored as well, and
    their tally is measured on the way; the storage summary, many small steps that leave most
    of the cluster idle, is made meanwhile. Stored jobs also have the ids of their tasks' clusters
    (``task_cluster_ids``), which the rules need; findings and report are without them.
    Returns the folder of each report table.
    """
    inventories = build_inventories(landed, as_of_ms, lookback_days)
    if "jobs" in landed:
        inventories["jobs"] = inventory.jobs_with_task_clusters(landed["jobs"])
    stored = store_inventories(store, inventories, force_refresh, stamped_at)

    def assess_stored() -> tuple[dict[str, DataFrame], dict]:
        found = assess(spark, stored, min_version, disallowed)
        assessed_jobs = found["jobs"].drop(inventory.TASK_CLUSTER_IDS)
        jobs, tally = store.measured("jobs_assessed", assessed_jobs, **rollups.tally())
        return {**found, "jobs": jobs}, {"jobs": tally}

    (assessed, tallies), storage_summary = run_together(
        spark, [assess_stored, partial(summarized_storage, stored)]
    )
    rolled_up = roll_up(spark, stored, assessed, tallies, summarize_storage=False)
    results = {**stored, **assessed, **rolled_up, "storage_summary": storage_summary}
    return write_report(spark, results, report_root, fmt)
