"""Centroid clustering with PCA-rotated filtering, exact in integers.

Vectors of whole numbers are rotated about their mean so that their variances come in
falling order (principal components, from sums over all vectors). Of the rotated form
only the leading coordinates and the norm of the rest are stored. For a vector x and a
centroid c the squared distance is at least

    |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2,

because norms of the rest differ by no more than the rest itself. The centroid with the
smallest bound is measured first, in integers; the others are measured only if their bound,
less a margin for rounding, does not exceed that distance. So every assignment, also of
ties, is that of all exact distances, and the rotation decides only about the work.

The vectors are a written table. Each round is one pass over it: tasks send a sum and a
count per cluster, which are added up as decimals; the driver sees k sums of as many
numbers as a vector has and sends k centroids back. A lost executor costs its tasks of
the round.

The first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed:id``, ties in the
order of their numbers. With fewer vectors there are fewer centroids. A centroid without
vectors stays. Null vectors, those of another dimension, and those with null or
non-finite components are not kept and get no row; nor are those with a component beyond
2**17, whose squared distances need not fit a long. Repeated rows and ids are vectors of
their own; a null id counts as ''. Other columns are not looked at. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatescope.llm.common import read_table, written

DIMENSION = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
LEAD = 16  # rotated coordinates that are kept
MARGIN = 1e-9  # of the squared norms, for rounding in the bounds
LIMIT = float(2**17)

STORED = "vec_id long, numbers binary, lead binary, rest double, norm double"


@dataclass(frozen=True)
class Rotation:
    """``axes`` has the leading components as columns; ``mean`` is taken away before."""

    mean: np.ndarray
    axes: np.ndarray

    def __call__(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading coordinates, norm of the rest, and squared norm of each row."""
        x = numbers - self.mean
        norm = (x * x).sum(axis=1)
        lead = x @ self.axes
        rest = x - lead @ self.axes.T
        return lead, np.sqrt((rest * rest).sum(axis=1)), norm


def whole_vectors(
    vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, numbers) of the vectors that are kept: floor(scale * component) as 32-bit integers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LIMIT * SCALE / scale))
    kept = rows.where((F.size("v") == dimension) & F.coalesce(fit, F.lit(False)))
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("numbers"))


def _matrix(lists: pa.Array, dimension: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimension)


def fitted(rows: DataFrame, dimension: int, lead: int) -> Rotation:
    """The rotation of all rows of ``whole_vectors``, from the sums of each task added up."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(dimension), np.zeros((dimension, dimension))
        for batch in batches:
            x = _matrix(batch.column(0), dimension).astype(np.float64)
            n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
        flat = np.concatenate([[n], first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

    parts = rows.select("numbers").mapInArrow(sums, "at long, value double")
    total = parts.groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")["value"].to_numpy()
    if not len(total) or not total[0]:
        return Rotation(np.zeros(dimension), np.eye(dimension)[:, :lead])
    n, first, second = total[0], total[1 : 1 + dimension], total[1 + dimension :].reshape(dimension, dimension)
    mean = first / n
    _, axes = np.linalg.eigh(second / n - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1][:, :lead]))


def rotated(rows: DataFrame, rotation: Rotation, dimension: int) -> DataFrame:
    """``whole_vectors`` with leading coordinates, norm of the rest and squared norm; a written table."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dimension)
            lead, rest, norm = rotation(x)
            packed = (pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype("<i4"), lead))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *packed, pa.array(rest), pa.array(norm)], names=["vec_id", "numbers", "lead", "rest", "norm"]
            )

    return written(rows.select("vec_id", "numbers").mapInArrow(turn, STORED), "rotated-vectors")


def nearest(
    numbers: np.ndarray, lead: np.ndarray, rest: np.ndarray, norm: np.ndarray, centroids: np.ndarray, rotation: Rotation
) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row, ties to the smaller number, and how many distances were measured."""
    c_lead, c_rest, c_norm = rotation(centroids)
    bound = (rest[:, None] - c_rest) ** 2
    for k in range(len(centroids)):
        bound[:, k] += ((lead - c_lead[k]) ** 2).sum(axis=1)
    bound -= MARGIN * (norm[:, None] + c_norm + 1)
    rows, first = np.arange(len(numbers)), bound.argmin(axis=1)

    def measured(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), 8192):
            some = slice(at, at + 8192)
            out[some] = ((numbers[i[some]] - centroids[k[some]]) ** 2).sum(axis=1)
        return out

    distance = np.full(bound.shape, np.iinfo(np.int64).max)
    distance[rows, first] = least = measured(rows, first)
    open_ = bound <= least[:, None]
    open_[rows, first] = False
    i, k = np.nonzero(open_)
    distance[i, k] = measured(i, k)
    best = distance.argmin(axis=1)
    return best, distance[rows, best], len(rows) + len(i)


def _unpacked(batch: pa.RecordBatch, names: tuple[str, ...], dimension: int) -> tuple:
    """numbers, lead, rest and norm of a batch of the written table."""
    at = {n: batch.column(n) for n in names}
    numbers = np.frombuffer(b"".join(at["numbers"].to_pylist()), "<i4").astype(np.int64).reshape(-1, dimension)
    lead = np.frombuffer(b"".join(at["lead"].to_pylist()), np.float64).reshape(len(numbers), -1)
    return numbers, lead, at["rest"].to_numpy(), at["norm"].to_numpy()


_POINT = ("numbers", "lead", "rest", "norm")


def _cluster_sums(table: DataFrame, centroids: np.ndarray, rotation: Rotation) -> tuple[dict[int, tuple[int, list[int]]], int]:
    """Of each non-empty cluster the number of vectors and the sums of their components, as Python's
    integers; and how many distances were measured."""
    k, dimension = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, *form = _unpacked(batch, _POINT, dimension)
            best, _, seen = nearest(numbers, *form, centroids, rotation)
            found = [(int(c), int((best == c).sum()), numbers[best == c].sum(axis=0)) for c in np.unique(best)]
            lists = [*zip(*found)] or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists[0], pa.int32()), pa.array(lists[1], pa.int64()), pa.array(list(lists[2]), pa.list_(pa.int64())), pa.array([seen] + [0] * (len(found) - 1) if found else [], pa.int64())],
                names=["cluster", "n", "sums", "seen"],
            )

    parts = table.select(*_POINT).mapInArrow(summed, "cluster int, n long, sums array<long>, seen long")
    exact = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dimension)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"), *exact).collect()
    found = {r["cluster"]: (r["n"], [int(r[f"s{d}"]) for d in range(dimension)]) for r in rows}
    return found, sum(r["seen"] for r in rows)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of their ids, in this order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = rows.select(F.sha2(text, 256).alias("hash"), "numbers").orderBy("hash", "numbers").limit(k).collect()
    return np.array([r["numbers"] for r in chosen], np.int64)


def clustered(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimension: int = DIMENSION,
    scale: int = SCALE,
    seed: int = SEED,
    lead: int = LEAD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(vec_id, cluster, distance) of all kept vectors; the final centroids; and, for each round,
    the share of distances that the bounds left to measure."""
    rows = whole_vectors(vectors, dimension, scale, id_col, vector_col)
    centroids = first_centroids(rows, k, seed).reshape(-1, dimension)
    if not len(centroids):
        return rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance").where("false"), centroids, []
    rotation = fitted(rows, dimension, min(lead, dimension))
    table = rotated(rows, rotation, dimension)
    shares = []
    for _ in range(rounds):
        found, seen = _cluster_sums(table, centroids, rotation)
        shares.append(seen / (sum(n for n, _ in found.values()) * len(centroids)))
        moved = centroids.copy()
        for c, (n, sums) in found.items():
            moved[c] = [s // n for s in sums]
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, *form = _unpacked(batch, _POINT, dimension)
            best, distance, _ = nearest(numbers, *form, centroids, rotation)
            arrays = [batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids, shares


def cluster_report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``clustered`` rows with cluster_inertia, inertia (null where a sum does not fit a long) and
    centroid_sha256 (of the centroid's numbers, joined by commas)."""
    assigned = written(assigned, "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["own"]) for r in assigned.groupBy("cluster").agg(exact.alias("own")).collect()}
    fits = lambda n: n if n < 2**63 else None
    told = [
        (c, fits(own), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, own in sums.items()
    ]
    schema = "of int, cluster_inertia long, inertia long, centroid_sha256 string"
    told = assigned.sparkSession.createDataFrame(told, schema)  # one row per centroid
    return assigned.join(F.broadcast(told), F.col("cluster") == F.col("of")).drop("of")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings after ten rounds."""
    assigned, centroids, _ = clustered(read_table(spark, sf_dir, "embeddings"))
    return cluster_report(assigned, centroids)


def _round_sql(r: int) -> str:
    """One round: the nearest centroid of each vector, then the centroids' new components."""
    return f"""a{r} AS MATERIALIZED (SELECT nr, c, x FROM (SELECT v.nr, v.x, k.c,
    row_number() OVER (PARTITION BY v.nr ORDER BY list_sum(list_transform(list_zip(v.x, k.y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), k.c) AS place
  FROM kept v, c{r} k) WHERE place = 1),
s{r} AS (SELECT c, d, sum(x[d])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, range(1, {DIMENSION + 1}) r(d) GROUP BY c, d),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS y FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.y, k.y) AS y FROM c{r} k LEFT JOIN m{r} m USING (c))"""


OP13_SQL = (
    f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSION}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS y FROM
  (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM kept ORDER BY h, x LIMIT {CLUSTERS})),
"""
    + ",\n".join(_round_sql(r) for r in range(ROUNDS))
    + f""",
assigned AS (SELECT nr, vec_id, c, y, d FROM (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY d, c) AS place FROM
  (SELECT v.nr, v.vec_id, k.c, k.y, list_sum(list_transform(list_zip(v.x, k.y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
   FROM kept v, c{ROUNDS} k)) WHERE place = 1)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM assigned
"""
)
