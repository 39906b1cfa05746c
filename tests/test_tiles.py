"""What a tile of pairs holds in memory, and that its blocks give what whole tiles give."""

import tracemalloc

import numpy as np

from caselattice.operators import similarity, text_naming


def test_a_tile_is_multiplied_in_bounded_blocks():
    rng = np.random.default_rng(1)
    m, w = rng.normal(size=(1500, 16)), rng.normal(size=(40_000, 16))
    w[::3], w[5] = w[0], m[0]
    tracemalloc.start()
    sims, ids = similarity.nearest(np.arange(1500), m, np.arange(40_000), w, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # 1500 rows of similarities at once are 480 MB
    whole = np.round(m @ w.T, 9)
    whole[np.arange(1500), np.arange(1500)] = -np.inf
    best = np.argsort(-whole, axis=1, kind="stable")[:, :3]
    assert (ids == best).all() and np.allclose(sims, np.take_along_axis(whole, best, 1), atol=2e-9)


def test_silhouette_over_several_blocks(spark):
    rng = np.random.default_rng(2)
    m, c = rng.normal(size=(4500, 2)), rng.integers(0, 3, 4500)
    far = np.linalg.norm(m[:, None] - m[None], axis=2)
    mean = np.stack([far[:, c == q].sum(1) / np.maximum((c == q).sum() - (c == q), 1) for q in range(3)], 1)
    a, b = mean[np.arange(4500), c], np.where(np.arange(3) == c[:, None], np.inf, mean).min(1)
    rows = spark.createDataFrame([(i, int(q), x.tolist()) for i, (x, q) in enumerate(zip(m, c))], "id long, label int, v array<double>")
    assert abs(similarity.silhouette(rows, block_rows=4500).first().silhouette - ((b - a) / np.maximum(a, b)).mean()) < 1e-4


def test_neighbours_that_are_known_are_not_compared_again(spark, monkeypatch):
    v = spark.createDataFrame([(i, i % 2, [1.0, float(i % 2), i / 50]) for i in range(12)], "id long, label int, v array<double>")
    near = similarity.knn(v.select("id", similarity.unit(v["v"]).alias("v")))
    want = sorted(map(tuple, similarity.justification(v).collect()))
    monkeypatch.setattr(similarity, "knn", None)
    assert sorted(map(tuple, similarity.justification(v, near).collect())) == want


def test_hashed_vectors_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, 0, "Alpha beta alpha"), (2, None, None), (3, 1, "x ! y"), (4, 1, "gamma " * 3000)], "id long, label int, text string")
    df = text_naming.hashed_vectors(docs)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    rows = {r.id: r for r in df.collect()}
    cell = {w: spark.sql(f"select pmod(xxhash64('{w}'), 64) c, if(xxhash64('{w}') < 0, -1, 1) s").first() for w in ("alpha", "beta", "gamma")}
    want = np.zeros(64)
    want[cell["alpha"].c] += 2 * cell["alpha"].s
    want[cell["beta"].c] += cell["beta"].s
    assert np.allclose(rows[1].v, want / np.linalg.norm(want)) and rows[2].label is None
    assert not any(rows[2].v) and not any(rows[3].v) and rows[4].v[cell["gamma"].c] == cell["gamma"].s
