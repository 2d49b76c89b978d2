"""Packing token sequences by the sum-of-squares rule.

A document's ids, with an end id, are one piece if they fit a sequence; a longer
document is cut so that all pieces but the first fill a sequence alone. The others are
dealt evenly into groups of bounded size. In each group the longest piece comes first,
and each goes into the open sequence where the sum, over all residual gaps, of the
squared number of open sequences with that gap becomes smallest; ties go to the
smallest gap. All lengths are known, so a new sequence is opened only for a piece that
fits no open one: opening by the sum as well, as is done where pieces arrive one by
one, took about 2 % more sequences. A group's work is bounded by its pieces and the sequence
length, and only piece lengths take part in it.

Texts of special tokens that stand in a document are those tokens. Null and empty texts
are the end id alone. Repeated rows and ids are packed row by
row; a null id stays null. Other columns are not looked at. An empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatescope.llm.common import read_table, written

SEQUENCE = 2048
END_ID = 0
GROUP = 16_384  # pieces that are packed together
RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def special_tokens(path: str | None = None) -> dict[str, int]:
    """Text and id of the special tokens that the tokenizer's file lists."""
    import json

    import public_tokenizers

    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def encoder(path: str | None = None, special: dict[str, int] | None = None):
    """Text to ids. The rank file holds the same vocabulary and merges as the tokenizer's and
    gives the same ids several times faster; the tests hold them against each other. The
    text of a ``special`` token is that token; what lies between is encoded by itself."""
    import base64
    import re

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encode = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary
    if not special:
        return encode
    marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def with_special(text: str) -> list[int]:
        parts = marks.split(text)
        if len(parts) == 1:
            return encode(text)
        return [i for part in parts for i in ([special[part]] if part in special else encode(part))]

    return with_special


def cut(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all but the first fill a sequence."""
    first = (n - 1) % sequence + 1
    return [(0, first)] + [(s, sequence) for s in range(first, n, sequence)]


def token_pieces(
    docs: DataFrame,
    sequence: int = SEQUENCE,
    tokenizer: str | None = None,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece; ``with_ids`` adds its ids as little-endian unsigned 32-bit bytes."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    special = special_tokens()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, special)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), sequence)):
                    data = ids[start : start + length].tobytes()
                    row = (doc_id.as_py(), k, start, length, zlib.crc32(data))
                    rows.append((*row, data) if with_ids else row)
            lists = list(zip(*rows)) or [()] * len(columns)
            arrays = [pa.array(x, kind) for x, kind in zip(lists, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each piece; lengths are 1 .. ``sequence``."""
    open_by_gap: list[list[int]] = [[] for _ in range(sequence + 1)]
    # Place g holds the number of open sequences with gap g. A full sequence has gap 0 and
    # is not counted: with -1/2 in its place the same formula gives its change.
    counts = np.zeros(sequence + 1)
    counts[0] = -0.5
    numbers, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        have = counts[size:]
        change = np.where(have > 0, 2 - 2 * have + 2 * counts[: len(have)], np.inf)
        at = int(change.argmin())
        if change[at] < np.inf:
            gap = at + size
            number = open_by_gap[gap].pop()
            counts[gap] -= 1
        else:
            gap, number = sequence, made
            made += 1
        numbers[i], offsets[i] = number, sequence - gap
        if gap > size:
            open_by_gap[gap - size].append(number)
            counts[gap - size] += 1
    return numbers, offsets


def pack(pieces: DataFrame, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """``pieces`` (with doc_id, piece, start, length, ids_crc32) and their sequence_id and offset.

    ``pieces`` is read more than once: give a written table.
    """
    short = pieces.where(F.col("length") < sequence)
    groups = max(1, ceil(short.count() / group))
    # The seed makes a task that is run again deal out its rows as before.
    dealt = short.withColumn("lot", F.floor(F.rand(29) * groups).cast("long"))
    # Long ids stay exact in pandas only in columns without nulls.
    dealt = dealt.withColumn("known", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        numbers, offsets = sum_of_squares(frame["length"].to_numpy(), sequence)
        return frame.assign(sequence_id=frame["lot"] * 2**32 + numbers, offset=offsets).drop(columns="lot")

    schema = PIECES + ", known boolean, sequence_id long, offset long"
    full = pieces.where(F.col("length") == sequence).select(
        "*",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    placed = dealt.groupBy("lot").applyInPandas(packed, schema)
    doc_id = F.when(F.col("known"), F.col("doc_id")).alias("doc_id")
    return placed.select(doc_id, *(c for c in full.columns if c != "doc_id")).unionByName(full)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 ids."""
    return pack(written(token_pieces(read_table(spark, sf_dir, "documents")), "pieces"))
