"""Tables in between: what several parts of a plan read is worked out once and written.

They lie in the folder that the cluster names for checkpoints (``spark.checkpoint.dir``),
else under the warehouse, so a lost executor costs a re-read. They are removed when the
session ends.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession


@dataclass(frozen=True)
class Kept:
    """A written table, its size on disk, and what was measured while it was written."""

    rows: DataFrame
    size: int
    metrics: dict[str, Any] = field(default_factory=dict)

    @property
    def broadcasts(self) -> bool:
        """Whether Spark broadcasts the table in a join: its size is under the session's threshold."""
        return self.size <= _bytes(self.rows.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/estatescope/{spark.conf.get('spark.app.id')}/{purpose}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, folder: str) -> tuple:
    """The file system of a folder and its path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def kept(df: DataFrame, purpose: str, **metrics: Column) -> Kept:
    """``df`` written once, with aggregates over its rows measured on the way."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, purpose)
    schema, seen = df.schema, Observation()
    if metrics:
        df = df.observe(seen, *(c.alias(name) for name, c in metrics.items()))
    df.write.parquet(folder)
    files, path = file_system(spark, folder)
    files.deleteOnExit(path)
    rows = spark.read.schema(schema).parquet(folder)
    return Kept(rows, files.getContentSummary(path).getLength(), seen.get if metrics else {})
