"""Rollups over assessed inventories. A missing dataset is passed as ``None``."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatescope.functions.findings import is_view
from estatescope.functions.paths import is_dbfs_root

ASSESSED = ("clusters", "jobs", "tables")

# The metrics of the overview, in order.
OVERVIEW_METRICS = (
    "Total Databases",
    "Total Tables",
    "Total Views",
    "Total Storage Locations",
    "Total Jobs",
    "Total Clusters",
    "Total Pipelines",
    "Total UDFs",
)


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def tally() -> dict[str, Column]:
    """What the readiness of an assessed inventory is made of: aggregates over its rows. They can
    be measured while the rows are written."""
    return {"total": F.count("*"), "ok": _count_if(F.size("findings") == 0)}


def readiness_summary(
    spark: SparkSession,
    assessed: Mapping[str, DataFrame | None],
    tallies: Mapping[str, Mapping[str, int]] | None = None,
) -> DataFrame:
    """Percentage of objects without findings, per object type, to one decimal.

    Worked out in whole numbers, halves rounded up. Null where there are no objects.
    Inventories whose ``tallies`` were measured are not read.
    """

    def tallied(object_type: str) -> DataFrame:
        kind, df = F.lit(object_type).alias("object_type"), assessed.get(object_type)
        known = (tallies or {}).get(object_type)
        if df is None:
            known = {"total": 0, "ok": 0}
        if known is not None:
            numbers = (F.lit(known[n] or 0).cast("bigint").alias(n) for n in ("total", "ok"))
            return spark.range(1).select(kind, *numbers)
        return df.agg(*(c.alias(n) for n, c in tally().items())).select(kind, "total", "ok")

    return _union([tallied(t) for t in ASSESSED]).select(
        "object_type",
        F.expr("((2000 * ok + total) div nullif(2 * total, 0)) / 10").alias("readiness"),
    )


def assessment_summary(
    spark: SparkSession, assessed: Mapping[str, DataFrame | None]
) -> DataFrame:
    """How often each finding occurs, most frequent first."""
    found = [
        df.select(F.explode_outer("findings").alias("finding")).where(F.col("finding").isNotNull())
        for df in (assessed.get(t) for t in ASSESSED)
        if df is not None
    ]
    if not found:
        return spark.createDataFrame([], "finding string, count bigint")
    return (
        _union(found)
        .groupBy("finding")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "finding")
    )


def grants_by_database(grants: DataFrame) -> DataFrame:
    return (
        grants.where(F.col("database").isNotNull())
        .groupBy("database")
        .agg(
            F.count("principal").alias("total_grants"),
            F.count_distinct("principal").alias("granted_principals"),
        )
    )


def database_summary(tables_assessed: DataFrame, grants: DataFrame | None) -> DataFrame:
    """Tables (views included), views, findings, and grants of each database."""
    per_database = (
        tables_assessed.where(F.col("catalog_schema").isNotNull())
        .groupBy(F.col("catalog_schema").alias("database"))
        .agg(
            F.count("table").alias("tables"),
            _count_if(is_view(F.col("table_type"))).alias("views"),
            _count_if(F.size("findings") > 0).alias("unsupported"),
            _count_if(is_dbfs_root(F.col("location"))).alias("dbfs_root"),
            _count_if(F.col("is_delta")).alias("delta_tables"),
        )
    )
    if grants is None:
        missing = F.lit(None).cast("bigint")
        return per_database.withColumns({"total_grants": missing, "granted_principals": missing})
    return per_database.join(grants_by_database(grants), "database", "left")


def overview(spark: SparkSession, inventories: Mapping[str, DataFrame | None]) -> DataFrame:
    """The eight headline counts; 0 for what is missing.

    One pass and one aggregate per inventory; only its counts are exchanged.
    """
    counted = {
        "external_locations": "Total Storage Locations",
        "mounts": "Total Storage Locations",
        "jobs": "Total Jobs",
        "clusters": "Total Clusters",
        "pipelines": "Total Pipelines",
        "udfs": "Total UDFs",
    }
    metrics = F.array(*[F.lit(m) for m in OVERVIEW_METRICS])
    parts = [
        spark.range(1).select(
            F.explode(metrics).alias("metric"), F.lit(0).cast("bigint").alias("value")
        )
    ]
    for name, metric in counted.items():
        df = inventories.get(name)
        if df is not None:
            total = df.agg(F.count("*").alias("value"))
            parts.append(total.select(F.lit(metric).alias("metric"), "value"))
    tables = inventories.get("tables")
    if tables is not None:
        view = is_view(F.col("table_type"))
        totals = {
            "Total Databases": F.count_distinct("catalog_schema"),
            "Total Tables": _count_if(~view),
            "Total Views": _count_if(view),
        }
        row = tables.agg(*[count.alias(metric) for metric, count in totals.items()])
        parts.append(row.unpivot([], list(totals), "metric", "value"))
    return (
        _union(parts)
        .groupBy("metric")
        .agg(F.sum("value").alias("value"))
        .orderBy(F.array_position(metrics, F.col("metric")))
    )
