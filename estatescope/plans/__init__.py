from estatescope.plans.assessment import (
    assess,
    build_assessment,
    build_inventories,
    countable,
    roll_up,
    run_assessment,
    store_inventories,
)
from estatescope.plans.stored_tables import store_table_parts, stored_tables

__all__ = [
    "assess",
    "build_assessment",
    "build_inventories",
    "countable",
    "roll_up",
    "run_assessment",
    "store_inventories",
    "store_table_parts",
    "stored_tables",
]
