"""Which keys of a large table occur more than once, without a row per key.

Keys travel in blocks of packed 64-bit numbers. A block asks about its distinct keys,
in one message per range of keys; the range's task sees which of them other blocks hold
too, and answers with one bit per key. Only entries with repeated keys become rows. A
key that is very frequent is one entry per block, so no key gathers rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatescope.llm.common import written

RANGE_KEYS = 1_000_000  # keys that the messages to one task hold, about
BLOCK_KEYS = 250_000
BLOCKS = "block string, n_keys long, keys binary, payload binary"
ASKED = "part long, block string, keys binary, twice binary"
ANSWERS = "block string, part long, repeated binary"


def packed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), kind)


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of 64-bit keys begins in sorted ``keys``, and the end."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of 64-bit keys each of ``keys`` is in."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.searchsorted(bounds, keys, side="right")


QUESTIONS = "part long, block string, keys binary, columns binary"
REPLIES = "phase int, block string, part long, bits binary"


def questions(block: str, keys: np.ndarray, columns: list[np.ndarray], parts: int) -> pd.DataFrame:
    """A block's messages: keys, and columns (int64) that go with them, in the block's order."""
    where = part_of(keys, parts)
    order = np.argsort(where, kind="stable")
    at = np.searchsorted(where[order], np.arange(parts + 1))
    rows = []
    for p in range(parts):
        some = order[at[p] : at[p + 1]]
        if len(some):
            # Neighbours are alike, so steps pack well.
            steps = np.diff(np.stack([c[some].astype(np.int64) for c in columns]), axis=1, prepend=0)
            rows.append((p, block, keys[some].tobytes(), packed(steps)))
    return pd.DataFrame(rows, columns=["part", "block", "keys", "columns"])


def replies(phase: int, decide, n_columns: int):
    """For ``applyInPandas`` by part: ``decide(keys, columns)`` gives a small number per key."""

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, np.uint64) for x in asked["keys"]]
        columns = [np.cumsum(unpacked(x, np.int64).reshape(n_columns, -1), axis=1) for x in asked["columns"]]
        bits = decide(np.concatenate(keys), np.concatenate(columns, axis=1)).astype(np.uint8)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        frame = pd.DataFrame({"block": asked["block"], "part": asked["part"], "bits": [packed(x) for x in np.split(bits, ends)]})
        frame.insert(0, "phase", phase)
        return frame

    return answer


def heard(answers: pd.DataFrame, phase: int, keys: np.ndarray, parts: int) -> np.ndarray:
    """The answers to ``questions``, in the order of ``keys``."""
    where = part_of(keys, parts)
    order = np.argsort(where, kind="stable")
    mine = answers[answers["phase"] == phase].sort_values("part")
    out = np.zeros(len(keys), np.uint8)
    if len(mine):
        out[order] = np.concatenate([unpacked(x, np.uint8) for x in mine["bits"]])
    return out


def block_row(block: str, keys: np.ndarray, payload: np.ndarray) -> tuple:
    """A row of ``BLOCKS``: unsigned 64-bit ``keys`` and, per key, a column of ``payload`` (int64)."""
    steps = np.diff(payload, axis=1, prepend=0)  # near entries are alike, so steps pack well
    return block, len(keys), keys.tobytes(), packed(steps)


def repeated_entries(blocks: DataFrame, columns: list[str], range_keys: int = RANGE_KEYS) -> DataFrame:
    """(key, *columns) of all entries whose key occurs more than once.

    ``blocks`` is a written table; if it is bucketed by block, it is not shuffled.
    """
    total = blocks.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    parts = max(1, ceil(total / range_keys))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, data in zip(batch["block"], batch["keys"]):
                keys, counts = np.unique(np.frombuffer(data, np.uint64), return_counts=True)
                at = ranges(keys, parts)
                rows = [
                    (p, block, keys[at[p] : at[p + 1]].tobytes(), packed(counts[at[p] : at[p + 1]] > 1))
                    for p in range(parts)
                    if at[p] < at[p + 1]
                ]
                yield pd.DataFrame(rows, columns=["part", "block", "keys", "twice"])

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, np.uint64) for x in asked["keys"]]
        twice = np.concatenate([unpacked(x, bool) for x in asked["twice"]])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        seen = np.bincount(place, 1 + twice) > 1
        ends = np.cumsum([len(k) for k in keys])
        bits = [packed(np.packbits(x)) for x in np.split(seen[place], ends[:-1])]
        return pd.DataFrame({"block": asked["block"], "part": asked["part"], "repeated": bits})

    def entries(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=["key", *columns], dtype=np.int64)
        keys = np.frombuffer(block["keys"].iloc[0], np.uint64)
        distinct, place = np.unique(keys, return_inverse=True)
        at = ranges(distinct, parts)
        repeated = np.zeros(len(distinct), bool)
        for part, data in zip(answers["part"], answers["repeated"]):
            bits = np.unpackbits(unpacked(data, np.uint8))
            repeated[at[part] : at[part + 1]] = bits[: at[part + 1] - at[part]]
        mine = np.flatnonzero(repeated[place])
        payload = np.cumsum(unpacked(block["payload"].iloc[0], np.int64).reshape(len(columns), -1), axis=1)
        return pd.DataFrame(
            {"key": keys[mine].view(np.int64), **{c: payload[i, mine] for i, c in enumerate(columns)}}
        )

    answers = blocks.select("block", "keys").mapInPandas(ask, ASKED).groupBy("part").applyInPandas(answer, ANSWERS)
    held = blocks.select("block", "keys", "payload").groupBy("block")
    schema = ", ".join(f"{c} long" for c in ["key", *columns])
    return written(held.cogroup(answers.groupBy("block")).applyInPandas(entries, schema), "repeated")
