import numpy as np
import pyarrow.parquet as pq
import pytest
from llm_cases import TABLES

from estatescope.llm.near_vectors import cell_keys, e8_steps, near_vectors, nearest_e8, op9_near_vectors


def brute(ids, vectors, labels, least=0.93):
    """(links, smallest reachable id) of each vector over all pairs."""
    good = [v is not None and len(v) and np.isfinite(np.array(v, float)).all() and np.any(v) and k is not None for v, k in zip(vectors, labels)]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for v, g in zip(vectors, good)]
    n, root = [0] * len(ids), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if good[i] and good[j] and labels[i] == labels[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    small = {}
    for i, v in enumerate(ids):
        small[find(i)] = min(small.get(find(i), v), v)
    return {v: (n[i], small[find(i)]) for i, v in enumerate(ids)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 AS rep", "1 AS times", "1 AS n_links", "'x' AS keys"
    )


def test_lattice():
    steps = e8_steps()
    assert steps.shape == (240, 8) and np.allclose((steps**2).sum(axis=1), 2)
    x = np.random.default_rng(0).normal(0, 3, (200, 8))
    own = nearest_e8(x)
    assert np.allclose(own * 2, np.rint(own * 2)) and (own.sum(axis=1) % 2 == 0).all()
    away = ((x - own) ** 2).sum(axis=1)
    assert all((away <= ((x - own - s) ** 2).sum(axis=1) + 1e-9).all() for s in steps)


@pytest.mark.parametrize("cosine", [0.93, 0.96])
def test_recall_of_the_tables(cosine):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal(a.shape)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    group = np.zeros(len(a), np.int64)
    p, q = (cell_keys(x, group, 4, 4, 1.5) for x in (a, cosine * a + np.sqrt(1 - cosine**2) * o))
    met = [(len(np.intersect1d(x, y)) > 0) for x, y in zip(p, q)]
    assert np.mean(met) >= 0.9


def test_all_embeddings_against_brute_force(spark):
    t = pq.read_table(f"{TABLES}/embeddings.parquet").to_pydict()
    want = brute(t["vec_id"], t["embedding"], t["label"])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op9_near_vectors(spark, TABLES).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_clusters_blocks_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = []
    for family in range(4):
        base = rng.standard_normal(32)
        for k in range(40 if family else 120):
            v = (base if k % 3 == 0 else base + rng.standard_normal(32) * 0.05).astype(np.float32)
            rows.append((len(rows), v.tolist(), family % 2))
    got = near_vectors(frame(spark, rows), block=16).collect()
    want = brute(*map(list, zip(*rows)))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_awkward_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (5, one, 1), (3, one, 1), (3, one, 1), (4, one, 2), (6, one, None), (7, None, 1), (8, [], 1), (9, [0.0] * 3, 1),
        (10, [float("nan"), 1.0, 2.0], 1), (11, [float("inf"), 1.0, 2.0], 1), (12, [None, 1.0, 2.0], 1),
        (13, [2.0, 4.0, 6.0], 1), (14, [1.0, 2.0], 1), (None, one, 1), (15, [-1.0, -2.0, -3.0], 1), (16, [1e-30, 2e-30, 3e-30], 1),
    ]
    got = near_vectors(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    of = lambda i: {(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] == i}
    assert of(5) == {(4, 3, False)} and of(3) == {(4, 3, True)} and of(13) == {(4, 3, False)} and of(16) == {(4, 3, False)}
    for alone in (4, 6, 7, 8, 9, 10, 11, 12, 14, 15):
        assert of(alone) == {(0, alone, True)}
    assert of(None) == {(0, None, True)}
    assert near_vectors(frame(spark, [])).count() == 0
