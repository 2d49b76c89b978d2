"""Small text and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: ASCII whitespace.
WHITESPACE = " \t\n\r\x0b\x0c"


def stripped(text: Column) -> Column:
    """The text without leading and trailing ASCII whitespace."""
    return F.trim(text, F.lit(WHITESPACE))


def non_empty_or(text: Column, other: Column) -> Column:
    """The text if it is neither null nor empty, else the other one as it is."""
    return F.coalesce(F.nullif(text, F.lit("")), other)


def as_json(value: Column) -> Column:
    """JSON text that keeps null fields."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def is_json(text: Column) -> Column:
    """True if the whole text is one JSON value; text after it, or a missing end, is not.

    The parser stops after a first value. Put inside an object and inside a list, the
    text must leave both well closed, with one entry.
    """
    kept = {"columnNameOfCorruptRecord": "bad"}
    inside = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string, bad string", kept)
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    return F.coalesce(inside.isNotNull() & inside["bad"].isNull() & (F.size(listed) == 1), F.lit(False))
