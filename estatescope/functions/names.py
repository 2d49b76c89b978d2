"""``catalog.schema`` names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the catalog that is never assessed.
SYSTEM_CATALOG = "system"


def qualified(catalog: Column, schema: Column) -> Column:
    """``catalog.schema``."""
    return F.concat_ws(".", catalog, schema)


def is_accessible_schema(catalog: Column, schema: Column) -> Column:
    """A named schema outside the system catalog."""
    return (catalog != SYSTEM_CATALOG) & (schema != "")


def is_accessible_name(name: Column) -> Column:
    """The same test on a ``catalog.schema`` name, split at its first dot.

    Written as prefix and length tests so the prefix test reaches the scan.
    """
    dot = F.instr(name, ".")
    return ~name.startswith(SYSTEM_CATALOG + ".") & (dot > 0) & (dot < F.length(name))
