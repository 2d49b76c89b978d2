"""Runtime version text such as ``11.3.x-scala2.12``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: leading whitespace, then major.minor.
MAJOR_MINOR = r"^\s*([0-9]+)\.([0-9]+)"


def _part(text: Column, number: int) -> Column:
    return F.regexp_extract(text, MAJOR_MINOR, number).try_cast("bigint")


def version_pair(text: Column) -> Column:
    """``struct<major, minor>`` of a version, null when the text has none."""
    major, minor = _part(text, 1), _part(text, 2)
    return F.when(
        major.isNotNull() & minor.isNotNull(),
        F.struct(major.alias("major"), minor.alias("minor")),
    )


def is_below(text: Column, minimum: str | None) -> Column:
    """Whether a version is lower than ``minimum``; false if either cannot be read."""
    lowest = version_pair(F.lit(minimum).cast("string"))
    # As the element of a list the parts are worked out once, also where nothing is compiled.
    parts = F.struct(_part(text, 1).alias("major"), _part(text, 2).alias("minor"))
    below = F.exists(
        F.array(parts), lambda p: p["major"].isNotNull() & p["minor"].isNotNull() & (p < lowest)
    )
    return F.coalesce(below, F.lit(False))
