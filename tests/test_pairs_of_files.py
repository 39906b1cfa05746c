"""All pairs of blocks of vectors: what is shuffled, the nearest by distance, and shares of neighbours over all rows."""

import numpy as np

from caselattice.operators import layout, similarity


def made(spark, m, name="v"):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"id long, {name} array<double>").repartition(3)


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(q).shuffleWriteBytes() for q in range(stages.size()))


def test_vectors_are_shuffled_once_however_many_blocks_there_are(spark):
    m = np.random.default_rng(4).normal(size=(2000, 64))
    v, before = made(spark, m).cache(), shuffled(spark)
    got = {(r.i, r.rank): r.j for r in similarity.knn(v, 3, block_rows=40).collect()}
    assert shuffled(spark) - before < 4 * m.nbytes  # each of 50 blocks met all others in a shuffle: 100 times the vectors
    sims = np.round(m @ m.T, 9)
    np.fill_diagonal(sims, -np.inf)
    best = np.argsort(-sims, axis=1, kind="stable")[:, :3]
    assert got == {(i, r + 1): best[i, r] for i in range(2000) for r in range(3)}


def test_a_block_of_vectors_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PACK_BYTES", 8 * 5 * 10)
    sizes = [(r.n, len(r.ids), len(r.vs)) for r in similarity._packed(made(spark, np.ones((333, 5))), None).collect()]
    assert sum(n for n, _, _ in sizes) == 333 and all(n <= 10 and i == 8 * n and v == 40 * n for n, i, v in sizes)


def nearest(m, k, far):
    sims = m @ m.T - (m * m).sum(1) / 2 if far else m @ m.T
    sims = np.round(sims, 9)
    np.fill_diagonal(sims, -np.inf)
    return np.argsort(-sims, axis=1, kind="stable")[:, :k]


def test_nearest_by_distance(spark):
    m = np.random.default_rng(6).normal(size=(300, 3)) * 9
    got = {(r.i, r.rank): r.j for r in similarity.knn(made(spark, m), 4, block_rows=21, by_distance=True).collect()}
    want = nearest(m, 4, True)
    assert got == {(i, r + 1): want[i, r] for i in range(300) for r in range(4)}


def test_kept_neighbours_are_told_of_all_rows(spark):
    """Rows whose id is divisible by 50 lie well, the others anywhere."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=(260, 3))
    m /= np.linalg.norm(m, axis=1)[:, None]
    places = np.where(np.arange(260)[:, None] % 50 == 0, m, rng.normal(size=(260, 3)))
    near, truth = nearest(places, 5, True), nearest(m, 10, False)
    share = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(near, truth)])
    got = layout.kept_neighbours(made(spark, m), made(spark, places, "space"), 5)
    assert abs(got - share) < 1e-9
