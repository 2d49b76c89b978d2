"""Stored inventories: one table each, replaced as a whole and stamped.

A snapshot is written to a folder of its own, under a name of its own; only when all of
it is there does the table move to it. So a refresh that fails halfway, or another one at the
same time, leaves the table with a whole snapshot, and who reads the former one goes on
reading: its folder stays until the table has moved once more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from estatescope.operators.kept import file_system

# Fixed value: the name of the stamp column.
STAMP = "_crawled_at"

# Table formats that replace their rows in one step themselves.
TRANSACTIONAL = ("delta", "iceberg", "hudi")
FORMER = "estatescope.former"


@dataclass(frozen=True)
class SnapshotStore:
    """Tables ``schema.name`` in a table format of the session.

    ``root`` is a folder all executors can reach; without it the schema's own is used.
    A snapshot also serves later plans as an input that is written once, so a lost
    executor costs no more than a re-read.
    """

    spark: SparkSession
    schema: str | None = None
    root: str | None = None
    fmt: str = "parquet"

    def table(self, name: str) -> str:
        return f"{self.schema}.{name}" if self.schema else name

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self.table(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self.table(name))

    def write(self, name: str, df: DataFrame, stamped_at: str | None = None, **how) -> DataFrame:
        """Replace the table by ``df`` and the time it was taken; return what was stored."""
        stamp = stamped_at or datetime.now(timezone.utc).isoformat()
        return self.keep(name, df.withColumn(STAMP, F.lit(stamp)), **how)

    def keep(self, name: str, df: DataFrame, key: Sequence[str] = (), buckets: int = 0) -> DataFrame:
        """Replace the table by ``df`` as it is; return what was stored.

        With ``buckets`` the rows are dealt by ``key`` and sorted in each bucket, so that
        tables of one key and number join without moving.
        """
        if self.fmt in TRANSACTIONAL:
            writer = df.write.mode("overwrite").format(self.fmt)
            (writer.option("path", f"{self.root}/{name}") if self.root else writer).saveAsTable(self.table(name))
            return self.read(name)
        version = uuid.uuid4().hex
        new, folder = self.table(f"{name}_{version}"), f"{self._root()}/{name}_{version}"
        if buckets:
            # One task per bucket: else every task writes a file for every bucket it meets.
            df = df.repartition(buckets, *key)
        writer = df.write.format(self.fmt).option("path", folder)
        if buckets:
            writer = writer.bucketBy(buckets, *key).sortBy(*key)
        try:
            writer.saveAsTable(new)
        except Exception:
            self.spark.sql(f"DROP TABLE IF EXISTS {new}")
            _delete(self.spark, folder)
            raise
        self._move(self.table(name), new, folder)
        return self.read(name)

    def measured(self, name: str, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """As ``keep``, with aggregates over the rows that were measured while they were written."""
        seen = Observation()
        stored = self.keep(name, df.observe(seen, *(c.alias(m) for m, c in metrics.items())))
        return stored, seen.get

    def materialize_or_read(
        self,
        name: str,
        build: Callable[[], DataFrame],
        force_refresh: bool = False,
        stamped_at: str | None = None,
    ) -> DataFrame:
        """The stored table; built and stored first if it is absent or to be refreshed."""
        if not force_refresh and self.exists(name):
            return self.read(name)
        return self.write(name, build(), stamped_at)

    def _root(self) -> str:
        if self.root:
            return self.root.rstrip("/")
        return self.spark.catalog.getDatabase(self.schema or self.spark.catalog.currentDatabase()).locationUri.rstrip("/")

    def _move(self, table: str, new: str, folder: str) -> None:
        """Let ``table`` be at ``folder``, where the whole table ``new`` is."""
        old = self._described(table) if self.spark.catalog.tableExists(table) else None
        if old is None:
            self.spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
            return
        layout = lambda d: [d.get(k) for k in ("columns", "Provider", "Num Buckets", "Bucket Columns")]
        if layout(old) == layout(self._described(new)):
            self.spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")
            self.spark.sql(f"DROP TABLE {new}")
        else:
            # Other columns or buckets: a table cannot change these and its place in one step.
            self.spark.sql(f"DROP TABLE {table}")
            self.spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
        self.spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{FORMER}' = '{old['Location']}')")
        self.spark.catalog.refreshTable(table)
        if old["former"]:
            _delete(self.spark, old["former"])

    def _described(self, table: str) -> dict:
        """Columns, place, layout and former place of a stored table."""
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
        properties = self.spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
        return {
            **{r["col_name"]: r["data_type"] for r in rows},
            "columns": self.spark.table(table).schema.simpleString(),
            "former": {r["key"]: r["value"] for r in properties}.get(FORMER),
        }


def _delete(spark: SparkSession, folder: str) -> None:
    files, path = file_system(spark, folder)
    files.delete(path, True)
