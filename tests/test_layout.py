"""The layout keeps more neighbours than principal components do, is the same for a seed, and takes small and equal tables."""

import numpy as np
from pyspark.sql import functions as F

from caselattice.operators import clustering, layout

SCHEMA = "id long, v array<double>"


def clusters(n=12, size=20, width=24):
    rng = np.random.default_rng(3)
    return np.concatenate([c + 0.3 * rng.normal(size=(size, width)) for c in rng.normal(size=(n, width))])


def made(spark, m, parts=2):
    return spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(m)], SCHEMA).repartition(parts)


def test_neighbours_are_kept_and_seeds_hold(spark):
    """More clusters than dimensions: principal components lay them over each other."""
    m = clusters()
    placed = layout.layout(made(spark, m), rounds=4).cache()
    flat = clustering.projected(made(spark, m), 3)[0].select("id", "space")
    kept, before = layout.kept_neighbours(made(spark, m), placed, 15, 5), layout.kept_neighbours(made(spark, m), flat, 15, 5)
    assert kept > 0.8 and kept > before
    again = {r.id: r.space for r in layout.layout(made(spark, m, 5), rounds=4).collect()}
    one = {r.id: r.space for r in placed.collect()}
    assert set(one) == set(range(240)) and max(abs(a - b) for i in one for a, b in zip(one[i], again[i])) < 1e-6


def test_graph_weights(spark):
    m = clusters(3, 12, 6)
    k = 5
    got = {(r.i, r.j): r.w for r in layout.fuzzy_graph(made(spark, m), k).collect()}
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    far = 1 - np.round(unit @ unit.T, 9)
    np.fill_diagonal(far, 9)
    one = {}
    for i in range(len(m)):
        near = np.argsort(far[i], kind="stable")[:k]
        over = far[i][near] - far[i][near[0]]
        grid = np.geomspace(1e-9, 10, 4000)
        scale = grid[np.abs(np.exp(-over[None, :] / grid[:, None]).sum(1) - np.log2(k)).argmin()]
        one |= {(i, int(j)): np.exp(-o / scale) for j, o in zip(near, over)}
    for (i, j), w in one.items():
        back = one.get((j, i), 0.0)
        assert abs(got[i, j] - (w + back - w * back)) < 0.02
    assert set(got) == set(one)


def test_small_and_equal(spark):
    for n in (0, 1, 2, 5):
        assert layout.layout(made(spark, clusters(1, max(n, 1), 6)[:n])).count() == n
    same = made(spark, np.ones((30, 4)))
    found = layout.layout(same).collect()
    assert len(found) == 30 and all(len(r.space) == 3 for r in found)
    assert layout.layout(made(spark, np.ones((1, 2)))).select(F.size("space")).first()[0] == 3
