"""Inventories built from landed metadata row sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatescope.functions.names import is_accessible_name, is_accessible_schema, qualified
from estatescope.functions.text import as_json, non_empty_or, stripped
from estatescope.sources.landed import no_rows
from estatescope.sources.schemas import METADATA

# What is recorded where the export says nothing.
UNKNOWN_TYPE = "UNKNOWN"
NO_PARTITIONS = "[]"
GRANT_LEVEL = "SCHEMA"

# Function fields in order of precedence, with the words that mark them.
UDF_FIELD_WORDS = (
    ("deterministic", ("deterministic",)),
    ("body", ("body", "expression")),
    ("return_type", ("return type", "returns")),
    ("input_types", ("arguments", "signature")),
)


def accessible_schemas(schemas: DataFrame, catalogs: Iterable[str] | None = None) -> DataFrame:
    """Distinct ``catalog.schema`` of (table_catalog, table_schema) rows.

    ``catalogs`` restricts the result to those; the system catalog is never included.
    """
    catalog, schema = F.col("table_catalog"), F.col("table_schema")
    if catalogs is not None:
        schemas = schemas.where(catalog.isin(list(catalogs)))
    return (
        schemas.where(is_accessible_schema(catalog, schema))
        .select(qualified(catalog, schema).alias("catalog_schema"))
        .distinct()
    )


def mounts_inventory(mounts: DataFrame) -> DataFrame:
    return mounts.select(F.col("mount_point").alias("mountPoint"), "source")


def grants_inventory(grants: DataFrame) -> DataFrame:
    """Schema grants, whichever of its two spellings a payload uses for each key."""
    name = F.col("database_name")
    spellings = F.json_tuple("payload", "Principal", "principal", "ActionType", "action_type")
    return (
        grants.where((F.col("object_type") == GRANT_LEVEL) & is_accessible_name(name))
        .select(name.alias("database"), "object_type", spellings.alias("p1", "p2", "a1", "a2"))
        .select(
            "database",
            "object_type",
            F.col("database").alias("object_name"),
            non_empty_or(F.col("p1"), F.col("p2")).alias("principal"),
            non_empty_or(F.col("a1"), F.col("a2")).alias("action_type"),
        )
    )


def _udf_field(key: Column) -> Column:
    """The field a description row sets: the first whose words occur in its lower-case key."""
    field = F.lit(None).cast("string")
    for name, words in reversed(UDF_FIELD_WORDS):
        mentioned = F.lit(False)
        for word in words:
            mentioned = mentioned | key.contains(word)
        field = F.when(mentioned, F.lit(name)).otherwise(field)
    return field


def udfs_inventory(listed: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """One row per listed function, with what its description says; nulls where it says nothing.

    ``info`` has one key/value row per (schema_name, function_name, ordinal), and
    optionally the text of a failed description in ``error``, which then is all there
    is. The last row that sets a field wins. The maximum of (ordinal, value) is combined
    before the shuffle, so a function with very many rows costs no more there than any
    other, and both sides are one row per function on the key of the join, dealt and sorted
    once.
    """
    # Names differ earlier than schemas do, so rows sort faster by them.
    key = ["function_name", "schema"]
    functions = (
        listed.where(is_accessible_name(F.col("schema_name")))
        # In the order of the key: else the join deals the described functions once more.
        .select("function_name", F.col("schema_name").alias("schema"))
        .distinct()
    )
    fields = ["input_types", "return_type", "deterministic", "body", "error"]
    if info is None:
        return functions.select("schema", "function_name", *(F.lit(None).cast("string").alias(f) for f in fields))
    described = _described(info)
    said = [F.when(F.col("error").isNull(), F.col(f)).alias(f) for f in fields[:-1]]
    return functions.join(described, key, "left").select("schema", "function_name", *said, "error")


def _described(info: DataFrame) -> DataFrame:
    error = F.col("error") if "error" in info.columns else F.lit(None).cast("string")
    # Each step of the rule looks at the key, so it is worked out before; values are stripped
    # where they won. White space around a key has no say in which words occur in it.
    rows = (
        info.where(is_accessible_name(F.col("schema_name")))
        .select(
            F.col("schema_name").alias("schema"),
            "function_name",
            F.lower("info_name").alias("key"),
            F.struct("ordinal", F.col("info_value").alias("value")).alias("entry"),
            error.alias("error"),
        )
        .withColumn("field", _udf_field(F.col("key")))
        # Rows that set nothing need not be sorted.
        .where(F.col("field").isNotNull() | F.col("error").isNotNull())
    )

    def last(field: str) -> Column:
        return stripped(F.max(F.when(F.col("field") == field, F.col("entry")))["value"]).alias(field)

    return rows.groupBy("function_name", "schema").agg(
        last("input_types"),
        last("return_type"),
        last("deterministic"),
        last("body"),
        F.max("error").alias("error"),
    )


def _partitions_json(details: DataFrame) -> Column:
    """Partition columns as JSON text, whether they landed as a list or as text."""
    column = F.col("partition_columns")
    if details.schema["partition_columns"].dataType.typeName() == "array":
        return F.coalesce(as_json(column), F.lit(NO_PARTITIONS))
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(NO_PARTITIONS))


# Names differ earlier than schemas do, so rows sort faster by them.
TABLE_KEY = ("table", "catalog_schema")


def listed_tables(listed: DataFrame) -> DataFrame:
    """One row per listed table: its key."""
    names = listed.where(is_accessible_name(F.col("catalog_schema")))
    return names.select(F.col("table_name").alias("table"), "catalog_schema").distinct()


def table_types(types: DataFrame) -> DataFrame:
    """One row per typed table: its key and known_type."""
    schema = qualified(F.col("table_catalog"), F.col("table_schema"))
    return (
        types.where(is_accessible_schema(F.col("table_catalog"), F.col("table_schema")))
        .groupBy(F.col("table_name").alias("table"), schema.alias("catalog_schema"))
        .agg(F.max("table_type").alias("known_type"))
    )


def table_details(details: DataFrame) -> DataFrame:
    """One row per described table: its key and details d."""
    return (
        details.where(is_accessible_name(F.col("catalog_schema")))
        .groupBy(F.col("table_name").alias("table"), "catalog_schema")
        .agg(
            F.max(
                F.struct(
                    "format",
                    "location",
                    F.col("size_in_bytes").alias("size"),
                    _partitions_json(details).alias("partition_columns"),
                    "error",
                )
            ).alias("d")
        )
    )


def joined_tables(tables: DataFrame, type_of: DataFrame, detail_of: DataFrame) -> DataFrame:
    """The inventory of ``listed_tables``, ``table_types`` and ``table_details``: one row to one row.

    Where the three are stored in buckets of their key, no row is moved.
    """
    table_type = F.coalesce("known_type", F.lit(UNKNOWN_TYPE))
    physical = table_type != "VIEW"
    described = physical & F.col("d").isNotNull() & F.col("d.error").isNull()

    def detail(name: str) -> Column:
        return F.when(described, F.col(f"d.{name}"))

    key = list(TABLE_KEY)
    return (
        tables.join(type_of, key, "left")
        .join(detail_of, key, "left")
        .select(
            "catalog_schema",
            "table",
            table_type.alias("table_type"),
            detail("format").alias("format"),
            detail("location").alias("location"),
            F.when(described, F.col("d.size")).otherwise(F.lit(0)).alias("size"),
            F.coalesce(detail("format") == "delta", F.lit(False)).alias("is_delta"),
            F.coalesce(detail("partition_columns"), F.lit(NO_PARTITIONS)).alias(
                "partition_columns"
            ),
            F.when(physical, F.col("d.error")).alias("error"),
        )
    )


def tables_inventory(
    listed: DataFrame, types: DataFrame | None = None, details: DataFrame | None = None
) -> DataFrame:
    """One row per listed table, with its type and storage details.

    Without ``types`` all types are unknown; without ``details`` nothing is described.
    A schema lists a name once, so rows that landed twice are one table. All three
    inputs are reduced to one row per table on the key of the joins: copies are
    combined before the shuffle, and each input is shuffled once. The table name is
    part of the key, which spreads a schema that holds a large share of the tables.
    """
    spark = listed.sparkSession
    types = no_rows(spark, METADATA["table_types"]) if types is None else types
    details = no_rows(spark, METADATA["table_details"]) if details is None else details
    return joined_tables(listed_tables(listed), table_types(types), table_details(details))
