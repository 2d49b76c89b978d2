"""Storage path prefixes (case-sensitive)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path prefixes and the storage classes they stand for.
EXTERNAL_PREFIXES = ("s3://", "s3a://", "abfss://", "wasbs://", "gs://", "adl://")
MNT_PREFIXES = ("dbfs:/mnt/", "/mnt/")
DBFS_PREFIX = "dbfs:/"
DBFS_FILE_PREFIX = "file:/dbfs/"
EXTERNAL = "EXTERNAL"
DBFS_MOUNT = "DBFS_MOUNT"
DBFS_ROOT = "DBFS_ROOT"
UNSUPPORTED = "UNSUPPORTED"


def starts_with_any(location: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [location.startswith(p) for p in prefixes])


def is_under_mnt(location: Column) -> Column:
    return starts_with_any(location, MNT_PREFIXES)


def is_under_dbfs(location: Column) -> Column:
    return location.startswith(DBFS_PREFIX)


def is_dbfs_root(location: Column) -> Column:
    """Under ``dbfs:/`` but not ``dbfs:/mnt/``; false for a missing location."""
    return F.coalesce(
        location.startswith(DBFS_PREFIX) & ~location.startswith(MNT_PREFIXES[0]), F.lit(False)
    )


def needs_mount_list(location: Column) -> Column:
    """Whether the class of a location depends on the mount points."""
    inside = location.startswith(DBFS_PREFIX) | location.startswith(DBFS_FILE_PREFIX)
    return F.coalesce(inside & ~is_under_mnt(location), F.lit(False))


def class_by_prefix(location: Column) -> Column:
    """Storage class of a location that does not depend on the mount points."""
    return (
        F.when(starts_with_any(location, EXTERNAL_PREFIXES), F.lit(EXTERNAL))
        .when(is_under_mnt(location), F.lit(DBFS_MOUNT))
        .otherwise(F.lit(UNSUPPORTED))
    )
