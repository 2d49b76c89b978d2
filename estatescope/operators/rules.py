"""Compatibility rules: inventories with a ``findings`` column.

Lists are exploded as outer and their nulls dropped after. A plain explode adds a
filter on the size of the list that is pushed down to where the list is made, and
would work it out (parser included) twice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatescope.functions.findings import (
    access_mode_finding,
    finding_list,
    format_finding,
    is_view,
    location_finding,
    version_finding,
)
from estatescope.operators.inventory import TASK_CLUSTER_IDS, task_cluster_ids
from estatescope.operators.kept import kept
from estatescope.operators.skew import inner_join_hot_apart, left_join_hot_apart
from estatescope.settings import DISALLOWED_ACCESS_MODES, MIN_RUNTIME_VERSION


def unsupported_versions(
    clusters: DataFrame, min_version: str | None = MIN_RUNTIME_VERSION
) -> DataFrame:
    """Clusters whose runtime version is below the minimum, with the finding."""
    finding = version_finding(F.col("spark_version"), min_version)
    return (
        clusters.select("cluster_id", "spark_version", finding.alias("finding"))
        .where(F.col("finding").isNotNull())
    )


def disallowed_access_modes(
    clusters: DataFrame, disallowed: Iterable[str] | None = DISALLOWED_ACCESS_MODES
) -> DataFrame:
    """Clusters whose access mode is not allowed, with the finding."""
    finding = access_mode_finding(F.col("access_mode"), disallowed)
    return (
        clusters.select("cluster_id", "access_mode", finding.alias("finding"))
        .where(F.col("finding").isNotNull())
    )


def assess_clusters(
    clusters: DataFrame,
    min_version: str | None = MIN_RUNTIME_VERSION,
    disallowed: Iterable[str] | None = DISALLOWED_ACCESS_MODES,
) -> DataFrame:
    return clusters.withColumn(
        "findings",
        finding_list(
            version_finding(F.col("spark_version"), min_version),
            access_mode_finding(F.col("access_mode"), disallowed),
        ),
    )


def assess_tables(tables: DataFrame) -> DataFrame:
    """Findings on format and location; views have none."""
    physical = ~is_view(F.col("table_type"))
    return tables.withColumn(
        "findings",
        finding_list(
            F.when(physical, format_finding(F.col("format"))),
            F.when(physical, location_finding(F.col("location"))),
        ),
    )


def _with_task_clusters(jobs: DataFrame, column: str) -> DataFrame:
    """Existing clusters of a job's tasks, each once in task order; empty if there are none.

    As the inventory kept them (``task_cluster_ids``), or taken from the typed ``tasks`` if it
    kept those, else from the JSON text.
    Never null, so that no null test of it is pushed down to run the parser again.
    """
    if TASK_CLUSTER_IDS in jobs.columns:
        return jobs.withColumn(column, F.coalesce(TASK_CLUSTER_IDS, F.array().cast("array<string>")))
    tasks = F.from_json("task_clusters", "array<struct<existing_cluster_id: string>>")
    if "tasks" in jobs.columns:
        tasks = F.col("tasks")
    return jobs.withColumn(column, task_cluster_ids(tasks))


def _findings_by_cluster(clusters_assessed: DataFrame) -> DataFrame:
    """(cluster_id, found): the distinct findings of an id, in finding order."""
    each = clusters_assessed.select("cluster_id", F.posexplode_outer("findings").alias("at", "finding"))
    return (
        each.where(F.col("finding").isNotNull())
        .groupBy("cluster_id")
        .agg(F.sort_array(F.collect_set(F.struct("at", "finding"))).alias("found"))
    )


def assess_jobs(
    jobs: DataFrame,
    clusters_assessed: DataFrame | None,
    min_version: str | None = MIN_RUNTIME_VERSION,
) -> DataFrame:
    """Findings on a job's own versions, then those of its tasks' clusters in task order.

    What a job inherits depends only on its list of clusters, so each distinct
    list is resolved once: it is exploded, joined with the clusters that have
    findings, put back in task order, and joined to all jobs with that list. Lists, the
    clusters' findings, and what each list inherits are written tables, made when this is called.
    """
    own = F.filter(
        F.transform(F.col("dbr_versions"), lambda v: version_finding(v, min_version)),
        lambda f: f.isNotNull(),
    )
    own = F.coalesce(own, F.array().cast("array<string>"))
    if clusters_assessed is None:
        return jobs.withColumn("findings", F.array_distinct(own))

    listed = _with_task_clusters(jobs, "_clusters")
    # From here on the lists are read as written: the jobs are read for them and for the last join.
    lists = kept(listed.groupBy("_clusters").agg(F.count("*").alias("_jobs")), "task-lists").rows
    tasks = lists.select(
        "_clusters", "_jobs", F.posexplode_outer("_clusters").alias("_task", "cluster_id")
    )
    in_task_order = F.sort_array(F.collect_list(F.struct("_task", "found")))
    found = kept(_findings_by_cluster(clusters_assessed), "cluster-findings")
    inherited = (
        inner_join_hot_apart(tasks, found, "cluster_id")
        .groupBy("_clusters", "_jobs")
        .agg(F.flatten(in_task_order["found"])["finding"].alias("_inherited"))
    )
    # Every list, also one that inherits nothing: a healthy list can be the most frequent.
    known = kept(
        lists.join(inherited.drop("_jobs"), "_clusters", "left"), "inherited", total=F.sum("_jobs")
    )
    return (
        left_join_hot_apart(
            listed,
            known,
            key="_clusters",
            value="_inherited",
            weight="_jobs",
            total=known.metrics["total"] or 0,
            unkeyed=F.size("_clusters") == 0,
        )
        .withColumn(
            "findings",
            F.array_distinct(
                F.concat(own, F.coalesce("_inherited", F.array().cast("array<string>")))
            ),
        )
        .drop("_clusters", "_inherited")
    )
