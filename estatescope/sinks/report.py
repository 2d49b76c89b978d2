"""The report: sixteen tables, each written to a folder of its own."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatescope.functions.text import as_json
from estatescope.sinks.together import run_together

# Title and dataset of each report table, in order.
REPORT_TABLES = (
    ("Assessment Overview", "overview"),
    ("Readiness Summary", "readiness_summary"),
    ("Assessment Summary", "assessment_summary"),
    ("Database Summary", "database_summary"),
    ("Tables", "tables"),
    ("UDFs", "udfs"),
    ("Storage Summary", "storage_summary"),
    ("External Locations", "external_locations"),
    ("Mount Points", "mounts"),
    ("Clusters", "clusters"),
    ("Cluster Policies", "cluster_policies"),
    ("Jobs", "jobs"),
    ("Submit Runs", "submit_runs"),
    ("Pipelines", "pipelines"),
    ("Global Init Scripts", "global_init_scripts"),
    ("Grants", "grants"),
)

# Fixed value: what stands for a missing dataset.
MISSING_INFO = "No data collected"


def flat_cells(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; all others unchanged."""
    nested = ("array", "map", "struct")
    return df.select(
        *[
            (as_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in nested else F.col(f"`{f.name}`"))
            .alias(f.name)
            for f in df.schema.fields
        ]
    )


def report_table(spark: SparkSession, df: DataFrame | None) -> DataFrame:
    """A dataset as it stands in the report."""
    if df is None:
        return spark.range(1).select(F.lit(MISSING_INFO).alias("info"))
    return flat_cells(df)


def write_report(
    spark: SparkSession,
    results: Mapping[str, DataFrame | None],
    root: str,
    fmt: str = "parquet",
) -> dict[str, str]:
    """Write all report tables under ``root``; folder of each dataset, in report order."""
    folders = {
        name: f"{root}/{place:02d}_{title.lower().replace(' ', '_')}"
        for place, (title, name) in enumerate(REPORT_TABLES, start=1)
    }

    def write(name: str) -> None:
        writer = report_table(spark, results.get(name)).write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.save(folders[name])

    run_together(spark, [partial(write, name) for name in folders])
    return folders
