import hashlib
import math

import numpy as np
import pytest
from llm_cases import TABLES, in_duck, rows_of

from estatescope.llm import centroid_clustering as cc


def whole(vector, dimension=64):
    """Python's integers of a vector that is kept, else None."""
    if vector is None or len(vector) != dimension or not all(x is not None and math.isfinite(x) for x in vector):
        return None
    return [math.floor(1024 * float(np.float32(x))) for x in vector]


def brute(rows, k, rounds, dimension):
    """(id, cluster, distance) by all distances in Python's integers, and the centroids."""
    kept = [(i, whole(v, dimension)) for i, v in rows]
    kept = [(i, x) for i, x in kept if x is not None]
    start = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    centroids = [x for _, x in start[:k]]

    def near():
        out = []
        for _, x in kept:
            distances = [sum((p - q) ** 2 for p, q in zip(x, c)) for c in centroids]
            out.append((distances.index(min(distances)), min(distances)))
        return out

    for _ in range(rounds):
        members = {}
        for (_, x), (c, _) in zip(kept, near()):
            members.setdefault(c, []).append(x)
        for c, xs in members.items():
            centroids[c] = [sum(col) // len(xs) for col in zip(*xs)]
    return [(i, *found) for (i, _), found in zip(kept, near())], centroids


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 AS label", "'x' AS cluster", "'x' AS numbers", "'x' AS hash"
    )


def plain(assigned):
    return sorted(map(repr, (tuple(r) for r in assigned.select("vec_id", "cluster", "distance").collect())))


def test_query_equals_sql(spark):
    names, want = in_duck(cc.OP13_SQL)
    assert rows_of(cc.op13_centroids(spark, TABLES), names) == want


@pytest.mark.parametrize("lead", [1, 3, 16])
def test_equals_all_distances(spark, lead):
    """Clusters of unlike width, equal vectors, and points as far from two centroids."""
    rng = np.random.default_rng(4)
    rows = []
    for family in range(5):
        middle = rng.normal(0, 1, 16)
        for _ in range(60):
            rows.append((len(rows), (middle + rng.normal(0, 0.02 + 0.1 * family, 16)).astype(np.float32).tolist()))
    rows += [(len(rows) + n, [float(n % 2)] + [0.0] * 15) for n in range(40)]
    assigned, centroids, shares = cc.clustered(frame(spark, rows), dimension=16, lead=lead, rounds=4)
    want, middles = brute(rows, 8, 4, 16)
    assert plain(assigned) == sorted(map(repr, want))
    assert centroids.tolist() == middles
    assert lead < 16 or max(shares) < 1


def test_bounds_are_below_distances_and_tight():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(0, 1, (500, 64)) * rng.gamma(1, 300, 64)).astype(np.int64)
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(x.T))
    turn = cc.Rotation(mean, np.ascontiguousarray(axes[:, ::-1][:, :16]))
    centroids = x[:8].copy()
    best, distance, seen = cc.nearest(x, *turn(x), centroids, turn)
    every = ((x[:, None, :] - centroids) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert seen < 0.5 * every.size
    ties = np.zeros((2, 64), np.int64)
    best, distance, _ = cc.nearest(ties, *turn(ties), np.stack([ties[0] + 2, ties[0] - 2, ties[0] + 2]), turn)
    assert best.tolist() == [0, 0] and distance.tolist() == [256, 256]


def test_awkward_vectors(spark):
    one = [0.5] * 4
    rows = [
        (1, one), (1, one), (1, [-0.25] * 4), (None, [0.1, -0.1, 0.0, 1.0]), (2, None), (3, []), (4, [0.5] * 5), (5, [None, 1.0, 1.0, 1.0]),
        (6, [float("nan")] * 4), (7, [float("-inf"), 0.0, 0.0, 0.0]), (8, [1e-30, -1e-30, 0.0, -0.0]), (2**62 + 1, [100.0, -100.0, 3.0, 4.0]),
        (9, [130000.0, -131000.0, 1.0, 1.0]),
    ]
    got, centroids, _ = cc.clustered(frame(spark, rows), k=4, rounds=3, dimension=4)
    want, middles = brute(rows, 4, 3, 4)
    assert plain(got) == sorted(map(repr, want)) and len(want) == 7
    assert centroids.tolist() == middles
    report = cc.cluster_report(got, centroids).collect()
    assert {r.inertia for r in report} == {sum(d for *_, d in want)}
    for r in report:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middles[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0] * 4)], [(1, [1.0] * 4)] * 3])
def test_few_vectors(spark, rows):
    assigned, centroids, _ = cc.clustered(frame(spark, rows), dimension=4)
    got = cc.cluster_report(assigned, centroids).collect()
    kept = sum(v is not None for _, v in rows)
    assert len(got) == kept and len(centroids) == kept
    assert all((r.cluster, r.distance, r.inertia) == (0, 0, 0) for r in got)
