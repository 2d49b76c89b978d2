"""Readers of landed exports.

Object records land as JSON lines, one object per line. They can be read typed
(``read_records``) or as raw text (``read_payloads``); the inventory operators
take either. Metadata row sets land as tables.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatescope.sources.schemas import INVENTORIES, METADATA, RECORDS, fields_of

CORRUPT = "_unreadable"
# A text that is no record: ASCII whitespace, and at most a null in it.
BLANK = r"\A[ \t\n\r\x0b\x0c]*+(?:null[ \t\n\r\x0b\x0c]*+)?\z"
# The part of a landed path that names the workspace.
ORIGIN = "workspace"

_FIELDS = {kind: fields_of(ddl) for kind, ddl in RECORDS.items()}


def read_records(spark: SparkSession, kind: str, *paths: str) -> DataFrame:
    """Typed records of one object type, without lines that cannot be read."""
    return parsed(read_payloads(spark, *paths), kind)


def read_payloads(spark: SparkSession, *paths: str) -> DataFrame:
    """One raw JSON record per row, in a string column ``payload``; blank lines are none."""
    lines = spark.read.text(list(paths)).select(F.col("value").alias("payload"))
    return lines.where(_is_record_text())


def _is_record_text() -> Column:
    # One look at the start decides for almost every text; trimming goes over all of it.
    return ~F.col("payload").rlike(BLANK)


def _parsed(payloads: DataFrame, kind: str, fields: Sequence[str] | None) -> tuple[DataFrame, Column]:
    """Typed columns, the text where it was not read in full, and whether nothing was read.

    Only ``fields`` are parsed, if they are given. The columns are generated, so filters on
    them run on what was parsed and do not parse again. The test for a record is part of that
    step: as a filter it would go below whatever makes the payload, and make it once more.
    """
    wanted = [f for f in _FIELDS[kind] if fields is None or f in fields]
    schema = ", ".join(f"{f} {_FIELDS[kind][f]}" for f in wanted)
    kept = {"columnNameOfCorruptRecord": CORRUPT}
    r = F.from_json("payload", f"{schema}, {CORRUPT} string", kept)
    rows = payloads.select(F.inline(F.when(_is_record_text(), F.array(r))))
    # A field of another type is null beside others; a broken text leaves nothing. The other
    # fields are looked at only in texts that could not be read in full.
    nothing = F.col(CORRUPT).isNotNull() & F.coalesce(*(F.col(c).cast("string") for c in wanted)).isNull()
    others = {f: t for f, t in _FIELDS[kind].items() if f not in wanted}
    if others:
        rest = F.from_json(CORRUPT, ", ".join(f"{f} {t}" for f, t in others.items()))
        nothing = nothing & F.coalesce(*(rest[f].cast("string") for f in others)).isNull()
    return rows, nothing


def parsed(payloads: DataFrame, kind: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Typed columns of the payloads that can be read: all, or those of ``fields``."""
    rows, nothing = _parsed(payloads, kind, fields)
    return rows.where(~nothing).drop(CORRUPT)


def readable_records(payloads: DataFrame, kind: str) -> DataFrame:
    """One row per payload that can be read, with its first field; nothing else is parsed."""
    return parsed(payloads, kind, [next(iter(_FIELDS[kind]))])


def unreadable_records(payloads: DataFrame, kind: str) -> DataFrame:
    """(kind, text) of the payloads that cannot be read."""
    rows, nothing = _parsed(payloads, kind, None)
    return rows.where(nothing).select(F.lit(kind).alias("kind"), F.col(CORRUPT).alias("text"))


def read_metadata(spark: SparkSession, kind: str, *paths: str, fmt: str = "parquet") -> DataFrame:
    """A metadata row set with its declared columns."""
    return spark.read.format(fmt).schema(METADATA[kind]).load(list(paths))


def path_origin(path: str) -> str | None:
    """The workspace that a landed path names, as in ``/landed/workspace=w1/jobs/part-0.json``."""
    found = re.search(rf"(?:^|/){ORIGIN}=([^/]+)/", path)
    return found and found[1]


def origin_of(export: DataFrame) -> str | None:
    """The one workspace that all files of an export name; several are refused, none is None."""
    named = {path_origin(f) for f in export.inputFiles()}
    if len(named) > 1:
        raise ValueError(f"files of several workspaces, or with and without one: {sorted(map(str, named))}")
    return named.pop() if named else None


def combine_exports(*exports: DataFrame, origins: Sequence[str] | None = None) -> DataFrame:
    """All rows of several exports of one kind; a column an export lacks is null.

    The exports must be of one workspace: names and ids are only unique in theirs, so
    an assessment is of one. Each export's workspace is taken from ``origins``, else from the
    paths of its files; two or more exports of which one is not known, or of different
    ones, are refused.
    """
    if not exports:
        raise ValueError("no exports")
    if origins is not None and len(origins) != len(exports):
        raise ValueError(f"{len(exports)} exports and {len(origins)} origins")
    if len(exports) > 1:
        named = list(origins) if origins is not None else [origin_of(e) for e in exports]
        if None in named:
            raise ValueError(f"the workspace of export {named.index(None) + 1} is not known: name the origins")
        if len(set(named)) > 1:
            raise ValueError(f"exports of several workspaces are assessed one by one: {sorted(set(named))}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), exports)


def no_rows(spark: SparkSession, ddl: str) -> DataFrame:
    """A declared schema without rows, as a plan that Spark knows to be empty."""
    return spark.range(0).select(*(F.lit(None).cast(t).alias(n) for n, t in fields_of(ddl).items()))


def empty_dataset(spark: SparkSession, kind: str) -> DataFrame:
    """An inventory with no rows and the declared columns."""
    return no_rows(spark, INVENTORIES[kind])
