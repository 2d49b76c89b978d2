"""Near-duplicate vectors by lattice hashing.

A vector is scaled to length 1 and, in each of several tables, projected to eight
dimensions at random and decoded to the nearest point of the E8 lattice; the next
nearest points of a small set are probed as well. Vectors of one label that share a
cell in any table are compared by cosine in double precision, and pairs at or above
the threshold are linked. A pair that shares several cells is looked at in the cell
with the smallest key only, so links are counted once without listing pairs.

Vectors that are equal are compared once and carry their number. A cell with more rows
than a block holds is cut into blocks by a hash of the id, and every pair of blocks is
a task of its own; no cell is capped, and no task holds more than two blocks. From a
comparison come one count and one link per vector, not its pairs.

Null labels, null or empty vectors, vectors of length zero and those with a null or
non-finite component link with nothing. Vectors of unequal dimension are not compared.
Recall is that of the lattice tables: it is measured against brute force in the tests.
Rows with equal ids are rows of their own. Other columns are not looked at. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatescope.llm.common import read_table, written
from estatescope.llm.components import connected_components

MIN_COSINE = 0.93
TABLES, PROBES = 4, 4
CELL = 1.5  # lattice spacing in units of a projected coordinate's deviation
BLOCK = 1024
SEED = 9


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: integers with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(odd))
    near[odd, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 and D8 shifted by one half in all coordinates."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def e8_steps() -> np.ndarray:
    """The 240 shortest vectors of E8: from a cell to its neighbours."""
    steps = []
    for i in range(8):
        for j in range(i):
            for s in (1, -1):
                for t in (1, -1):
                    step = np.zeros(8)
                    step[i], step[j] = s, t
                    steps.append(step)
    for signs in range(256):
        bits = [(signs >> k) & 1 for k in range(8)]
        if sum(bits) % 2 == 0:
            steps.append(np.array([0.5 - b for b in bits]))
    return np.array(steps)


def cell_keys(
    unit: np.ndarray, groups: np.ndarray, tables: int, probes: int, cell: float, seed: int = SEED
) -> np.ndarray:
    """(rows, tables * (1 + probes)) keys: each row's own cell and its nearest neighbour cells."""
    dim, out = unit.shape[1], []
    odd = np.random.default_rng(seed + 1).integers(1, 2**62, 8, dtype=np.int64) * 2 + 1
    steps = e8_steps()
    for table in range(tables):
        draw = np.random.default_rng([seed, table, dim])
        turn, shift = draw.standard_normal((dim, 8)), draw.random(8)
        x = unit @ turn / cell + shift
        own = nearest_e8(x)
        # A neighbour own + step is nearer, the larger the residual's part along the step.
        gain = 2 * (x - own) @ steps.T - (steps**2).sum(axis=1)
        best = np.argpartition(-gain, probes, axis=1)[:, :probes]
        cells = np.concatenate([own[:, None, :], own[:, None, :] + steps[best]], axis=1)
        with np.errstate(over="ignore"):
            key = (np.rint(cells * 2).astype(np.int64) * odd).sum(axis=2) + (groups * 31 + table)[:, None] * odd[0]
            key ^= key >> 31
            out.append(key * odd[1] ^ (key >> 29))
    return np.concatenate(out, axis=1)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` over pairs (a, b)."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def vector_links(
    vectors: DataFrame,
    min_cosine: float = MIN_COSINE,
    tables: int = TABLES,
    probes: int = PROBES,
    cell: float = CELL,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """For (rep, label, embedding, times) with one row per distinct vector: (rep, found), the
    linked vectors per row, copies counted; and links (a, b) that connect what is linked."""
    keyed_schema = "rep long, times long, embedding array<float>, keys array<long>"

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["embedding"].map(len)):
                groups = part["label"].to_numpy(np.int64) * 1009 + dim
                keys = cell_keys(_unit(part["embedding"]), groups, tables, probes, cell)
                yield part.assign(keys=list(keys))[["rep", "times", "embedding", "keys"]]

    rows = written(vectors.mapInPandas(keyed, keyed_schema), "cells")
    placed = rows.withColumn("key", F.explode(F.array_distinct("keys")))
    sizes = placed.groupBy("key").count().where("count > 1")
    blocks = F.ceil(F.col("count") / block).cast("int")
    # Block i of a cell goes to the tasks (i, j) and (j, i) for all j: each pair of blocks meets.
    dealt = (
        placed.join(sizes, "key")
        .withColumn("own", F.pmod(F.hash("rep"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("count", "other")
    )

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        key, lo, hi = int(frame["key"].iloc[0]), int(frame["lo"].iloc[0]), int(frame["hi"].iloc[0])
        frame = frame.drop_duplicates("rep").reset_index(drop=True)
        left = np.flatnonzero(frame["own"] == lo)
        right = np.flatnonzero(frame["own"] == hi)
        unit, keys = _unit(frame["embedding"]), np.stack(frame["keys"].to_numpy())
        rep, times = frame["rep"].to_numpy(), frame["times"].to_numpy()
        found = np.zeros(len(frame), np.int64)
        firsts, seconds = [], []
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            i, j = np.nonzero(unit[some] @ unit[right].T >= min_cosine - 1e-9)
            i, j = some[i], right[j]
            once = i < j if lo == hi else i != j
            i, j = i[once], j[once]
            exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= min_cosine
            i, j = i[exact], j[exact]
            for part in range(0, len(i), 65_536):
                p, q = i[part : part + 65_536], j[part : part + 65_536]
                shared = (keys[p][:, :, None] == keys[q][:, None, :]).any(axis=2)
                least = np.where(shared, keys[p], np.iinfo(np.int64).max).min(axis=1)
                p, q = p[least == key], q[least == key]
                np.add.at(found, p, times[q])
                np.add.at(found, q, times[p])
                firsts.append(p)
                seconds.append(q)
        a = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
        b = np.concatenate(seconds) if seconds else np.empty(0, np.int64)
        root = _roots(len(frame), a, b)
        linked = np.flatnonzero(found)
        return pd.DataFrame({"rep": rep[linked], "found": found[linked], "root": rep[root[linked]]})

    pairs = dealt.groupBy("key", "lo", "hi").applyInPandas(compared, "rep long, found long, root long")
    pairs = written(pairs, "vector-links")
    return pairs.groupBy("rep").agg(F.sum("found").alias("found")), pairs.select(
        F.col("rep").alias("a"), F.col("root").alias("b")
    )


def near_vectors(
    vectors: DataFrame,
    min_cosine: float = MIN_COSINE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    **index,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding"), F.col(label_col).alias("label")
    )
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & ~zero, F.lit(False))
    # A node is a distinct vector under its label, by hash: ids may repeat.
    node = F.xxhash64("label", "embedding").alias("rep")
    alike = rows.where(usable).groupBy("label", "embedding", node).agg(
        F.min("vec_id").alias("least"), F.count("*").alias("times")
    )
    counts, links = vector_links(alike, min_cosine, **index)
    roots = alike.select("rep", "least").join(
        connected_components(links).withColumnRenamed("id", "rep"), "rep", "left"
    )
    roots = roots.withColumn("root", F.coalesce("component_id", "rep")).select("rep", "least", "root")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    known = (
        alike.join(counts, "rep", "left")
        .join(roots.drop("least").join(least, "root"), "rep")
        .select(
            F.col("label").alias("of_label"),
            F.col("embedding").alias("of_embedding"),
            (F.coalesce("found", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            "component_id",
        )
    )
    return (
        rows.withColumn("usable", usable)
        .join(
            known,
            F.col("usable") & (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of_embedding")),
            "left",
        )
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
        )
    )


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
