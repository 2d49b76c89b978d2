"""Sharding: a Feistel permutation over global row numbers gives shard and slot.

Rows are numbered from 0 in an order that depends on their content alone: by bucket
of a hash, then by id, checksum and size. A keyed Feistel network permutes the
numbers, walking along its cycles until a number is below the row count, so the
permutation is exact for any count. Permuted number ``p`` goes to shard ``p % shards``
at slot ``p // shards``: shard sizes differ by one row at most, slots have no gaps,
and both can be computed (and inverted) without looking at other rows.

Rows that are equal in id, text and size are counted before the shuffle and numbered
as a run, so a row that is repeated very often does not gather in one task. A null
text counts no bytes and has checksum 0; a null id is an id of its own. Other columns
of the input are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatescope.llm.common import read_table

SHARDS = 40
ROW_OVERHEAD = 16
RUN = 100_000  # rows of a repeated row that are listed at a time
ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """Keyed scrambling of unsigned 64-bit numbers; the round function of the network."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(1, 2**63, ROUNDS)]


def _half_bits(count: int) -> int:
    return max(1, (max(count - 1, 1).bit_length() + 1) // 2)


def _walk(numbers: np.ndarray, count: int, one_pass) -> np.ndarray:
    """Apply the network again to what fell outside; the expected number of passes is under 4."""
    out = one_pass(numbers.astype(np.uint64))
    outside = np.flatnonzero(out >= np.uint64(count))
    while len(outside):
        out[outside] = one_pass(out[outside])
        outside = outside[out[outside] >= np.uint64(count)]
    return out.astype(np.int64)


def permute(numbers: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Where each of 0 .. count - 1 goes; a bijection for each seed."""
    half, keys = np.uint64(_half_bits(count)), _keys(seed)
    mask = np.uint64((1 << int(half)) - 1)

    def one_pass(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        return (left << half) | right

    return _walk(numbers, count, one_pass)


def unpermute(places: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Inverse of ``permute``: the row number that a shard and slot hold."""
    half, keys = np.uint64(_half_bits(count)), _keys(seed)
    mask = np.uint64((1 << int(half)) - 1)

    def one_pass(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in reversed(keys):
            left, right = right ^ (_mix(left, key) & mask), left
        return (left << half) | right

    return _walk(places, count, one_pass)


def shard_rows(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = 7,
    buckets: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, size, text_crc32, row_number, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    alike = alike.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    # One row per bucket, a fixed number of them, whatever the input.
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (
        alike.groupBy("bucket")
        .agg(F.sum("times").alias("in_bucket"))
        .select(
            "bucket",
            (F.sum("in_bucket").over(every) - F.col("in_bucket")).alias("bucket_start"),
            F.sum("in_bucket").over(Window.partitionBy()).alias("total"),
        )
    )
    before = (
        Window.partitionBy("bucket")
        .orderBy("doc_id", "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        alike.withColumn("run_start", F.sum("times").over(before) - F.col("times"))
        .join(starts, "bucket")
        .withColumn("run_start", F.col("run_start") + F.col("bucket_start"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("times") - 1) / RUN).cast("int"))))
        .withColumn("first", F.col("part").cast("long") * RUN)
        .withColumn(
            "within",
            F.explode(F.sequence(F.col("first"), F.least(F.col("first") + RUN, F.col("times")) - 1)),
        )
        .withColumn("row_number", F.col("run_start") + F.col("within"))
    )

    @F.pandas_udf("long")
    def permuted(number: pd.Series, total: pd.Series) -> pd.Series:
        if not len(number):
            return number
        return pd.Series(permute(number.to_numpy(), int(total.iloc[0]), seed))

    return placed.withColumn("place", permuted("row_number", "total")).select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
    )


def op1_shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39; counts are at most one apart."""
    return shard_rows(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
