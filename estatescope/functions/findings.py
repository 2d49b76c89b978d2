"""Finding texts and the conditions that raise them.

Each finding is a text column that is null where the rule does not apply.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatescope.functions.paths import is_under_dbfs, is_under_mnt
from estatescope.functions.versions import is_below

# The texts of the findings and the mode with a text of its own.
OLD_VERSION = "not supported DBR: "
NO_ISOLATION = "NO_ISOLATION"
NO_ISOLATION_TEXT = "No isolation shared clusters not supported in UC"
BAD_ACCESS_MODE = "cluster type not supported : "
NOT_DELTA = "Non-DELTA format: "
IN_DBFS_MOUNT = "Data is in DBFS Mount"
IN_DBFS_ROOT = "Data is in DBFS Root"


def finding_list(*findings: Column) -> Column:
    """The findings that are not null, in order and without repeats; never null."""
    return F.array_except(F.array(*findings), F.array(F.lit(None).cast("string")))


def version_finding(version: Column, minimum: str | None) -> Column:
    return F.when(is_below(version, minimum), F.concat(F.lit(OLD_VERSION), version))


def access_mode_finding(mode: Column, disallowed: Iterable[str] | None) -> Column:
    refused = (mode != "") & mode.isin(list(disallowed or ()))
    return F.when(refused & (mode == NO_ISOLATION), F.lit(NO_ISOLATION_TEXT)).when(
        refused, F.concat(F.lit(BAD_ACCESS_MODE), mode)
    )


def is_view(table_type: Column) -> Column:
    """Case-insensitive view test; a missing type is not a view."""
    return F.coalesce(F.upper(table_type) == "VIEW", F.lit(False))


def format_finding(table_format: Column) -> Column:
    other = (table_format != "") & (F.lower(table_format) != "delta")
    return F.when(other, F.concat(F.lit(NOT_DELTA), F.upper(table_format)))


def location_finding(location: Column) -> Column:
    return F.when(is_under_mnt(location), F.lit(IN_DBFS_MOUNT)).when(
        is_under_dbfs(location), F.lit(IN_DBFS_ROOT)
    )
