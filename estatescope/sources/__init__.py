from estatescope.sources.landed import (
    combine_exports,
    empty_dataset,
    origin_of,
    parsed,
    read_metadata,
    read_payloads,
    read_records,
    readable_records,
    unreadable_records,
)

__all__ = [
    "combine_exports",
    "empty_dataset",
    "origin_of",
    "parsed",
    "read_metadata",
    "read_payloads",
    "read_records",
    "readable_records",
    "unreadable_records",
]
