"""Joins that stay even when one key holds a large share of the rows, matched or not.

A key is heavy if it has more rows than an even share of a shuffle partition. There
are fewer such keys than partitions, so what the lookup says of them, also that it
says nothing, is small enough to broadcast; nothing else is capped, copied or salted.
Rows that need no match are spread by the number of the input partition: it is the
same when a lost task is run again, and also spreads rows that are equal throughout.

What is known of the keys is a written table (``kept``): the heavy ones and the others
are two reads of it, and the total is measured while it is written, so the plans
behind it are not part of the join's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatescope.operators.kept import Kept, kept


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def left_join_hot_apart(
    facts: DataFrame,
    known: DataFrame | Kept,
    key: str,
    value: str,
    weight: str,
    total: int | None = None,
    unkeyed: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``facts`` with column ``value`` of ``known``.

    ``known`` has one row for each key that the facts have: its ``weight``, the number
    of facts, and its ``value``, null where there is no match; ``total`` is the sum of the
    weights, and is worked out if it is not given. Facts that are ``unkeyed``, or settled
    by a heavy key, are spread; the others go through a normal join with the values that
    there are. A written ``known`` that Spark broadcasts is joined as it is.
    """
    if isinstance(known, Kept):
        if known.broadcasts:
            looked_up = known.rows.select(F.col(key).alias("_known_key"), value)
            return facts.join(looked_up, F.col(key) == F.col("_known_key"), "left").drop("_known_key")
        known = known.rows
    partitions = partitions or _partitions(facts)
    every = known.agg(F.sum(weight)).scalar() if total is None else F.lit(total)
    hot = known.where(F.col(weight) * partitions > every).select(
        F.col(key).alias("_hot_key"), F.col(value).alias("_hot_value")
    )
    rest = known.where(F.col(value).isNotNull()).select(
        F.col(key).alias("_cold_key"),
        F.xxhash64(key).alias("_slot"),
        F.col(value).alias("_cold_value"),
    )
    settled = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    if unkeyed is not None:
        settled = settled | unkeyed
    return (
        facts.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_slot", F.when(settled, F.spark_partition_id()).otherwise(F.xxhash64(key)))
        .withColumn("_cold_key", F.when(~settled, F.col(key)))
        .join(rest, ["_cold_key", "_slot"], "left")
        .withColumn(value, F.coalesce("_hot_value", "_cold_value"))
        .drop("_hot_key", "_hot_value", "_cold_key", "_cold_value", "_slot")
    )


def inner_join_hot_apart(
    facts: DataFrame, lookup: DataFrame | Kept, key: str, partitions: int | None = None
) -> DataFrame:
    """Inner join of ``facts`` with a ``lookup`` of one row per key.

    A written lookup that Spark broadcasts is joined as it is. Otherwise ``facts`` are read
    twice, for the number of each key and for the join.
    """
    if isinstance(lookup, Kept):
        if lookup.broadcasts:
            return facts.join(lookup.rows, key)
        lookup = lookup.rows
    others = [c for c in lookup.columns if c != key]
    found = lookup.select(F.col(key), F.struct(F.lit(True).alias("_met"), *others).alias("_found"))
    counted = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    known = kept(counted.join(found, key, "left"), "known", total=F.sum("_n"))
    total = known.metrics["total"] or 0
    joined = left_join_hot_apart(facts, known.rows, key, "_found", "_n", total, partitions=partitions)
    return (
        joined.where(F.col("_found").isNotNull())
        .withColumns({c: F.col("_found")[c] for c in others})
        .drop("_found")
    )
