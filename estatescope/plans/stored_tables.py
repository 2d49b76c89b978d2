"""The parts of the table inventory as stored tables, dealt by the key of its joins.

Listing, types and details are each reduced to one row per table and stored in the same
number of buckets of that key. Whatever is built on them, inventory, findings, storage
classes or database summary, then joins them bucket by bucket without moving a row, and
a refresh of one part leaves the others as they are.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import ceil

from pyspark.sql import DataFrame

from estatescope.operators.metadata import TABLE_KEY, joined_tables, listed_tables, table_details, table_types
from estatescope.sinks import SnapshotStore

# Stored name -> landed input and how it is reduced.
PARTS = {
    "listed_tables": ("table_list", listed_tables),
    "table_types": ("table_types", table_types),
    "table_details": ("table_details", table_details),
}
BUCKET_ROWS = 2_000_000  # listed tables to a bucket, about


def bucket_number(listed: DataFrame, rows: int = BUCKET_ROWS) -> int:
    """Buckets for a listing: by its size, and enough to keep all cores busy."""
    return max(listed.sparkSession.sparkContext.defaultParallelism, ceil(listed.count() / rows))


def store_table_parts(store: SnapshotStore, landed: Mapping[str, DataFrame], buckets: int | None = None) -> None:
    """Store the parts that were landed; the buckets of all parts must be equal in number."""
    if buckets is None:
        buckets = bucket_number(landed["table_list"])
    for name, (source, reduced) in PARTS.items():
        if source in landed:
            store.keep(name, reduced(landed[source]), key=TABLE_KEY, buckets=buckets)


def stored_tables(store: SnapshotStore) -> DataFrame:
    """The table inventory of the stored parts."""
    return joined_tables(*(store.read(name) for name in PARTS))
