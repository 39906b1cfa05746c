"""The inverted file: exact where all lists are probed, recall where they aren't, copies, ties, small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselattice.operators import neighbour_index as ni
from caselattice.operators import similarity

SCHEMA = "id long, v array<double>"


def made(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in x]) for i, x in enumerate(m)], SCHEMA)


def unit(m):
    return m / np.linalg.norm(m, axis=1)[:, None]


def plain(rows, k=3):
    out = []
    for i, v in rows:
        near = sorted((-round(float(np.dot(v, w)), 9), j) for j, w in rows if j != i)[:k]
        out += [(i, j, -s, r + 1) for r, (s, j) in enumerate(near)]
    return sorted(out)


def got(df):
    return sorted((r.i, r.j, r.sim, r.rank) for r in df.collect())


def test_all_lists_are_exact_also_in_tiles(spark, monkeypatch):
    """With small tiles, so that lists are cut on both sides."""
    monkeypatch.setattr(ni, "TILE_ROWS", 7)
    m = unit(np.random.default_rng(1).normal(size=(150, 8)))
    df = made(spark, m)
    assert got(ni.knn_index(df, 3, probes=99)) == got(similarity.knn(df)) == plain([(i, x) for i, x in enumerate(m)])


def test_copies_and_ties(spark):
    """A third of all rows is one vector: its rows are each other's neighbours, the smallest ids first, and rows near it see its first ids."""
    rng = np.random.default_rng(2)
    m = unit(np.round(rng.normal(size=(60, 4)), 1))
    m[rng.permutation(60)[:20]] = m[5]
    m[40] = m[41]
    df = made(spark, m)
    assert got(ni.knn_index(df, 3, probes=99)) == plain([(i, x) for i, x in enumerate(m)])


def test_recall_of_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    m = unit(np.concatenate([c + rng.normal(size=(50, 16)) for c in centres]))
    df = made(spark, m)
    reps = df.select(F.col("id").alias("rep"), "v")
    centres = ni.fitted(reps, 2000, 44, 1)
    probes = ni.calibrated(reps, centres, 3, 0.95, 1)
    assert 1 <= probes <= 15  # far from all 44
    found = ni.recall(ni.knn_index(df, 3, probes=probes), df).first()
    assert found["queries"] == 40 and found["recall"] >= 0.9


def test_exact_in_blocks(spark):
    m = unit(np.random.default_rng(4).normal(size=(90, 5)))
    df, rows = made(spark, m).repartition(5), [(i, x) for i, x in enumerate(m)]
    want = [r for r in plain(rows) if r[0] % 7 == 0]
    assert got(ni.exact(df.where("id % 7 = 0"), df, 3, block=4)) == want
    assert ni.exact(df.where("false"), df, 3).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    m = unit(np.random.default_rng(5).normal(size=(n, 3))) if n else np.zeros((0, 3))
    df = made(spark, m).unionByName(spark.createDataFrame([(None, [1.0, 0.0, 0.0]), (99, None)], SCHEMA))
    if n:
        assert got(similarity.knn(df.where("id < 9 and v is not null"))) == plain([(i, x) for i, x in enumerate(m)])
    assert got(ni.knn_index(df)) == plain([(i, x) for i, x in enumerate(m)])


def test_a_query_travels_once_a_shelf(spark, monkeypatch):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")
    sent, real = [], type(df).groupBy

    def seen(frame, *cols):
        if cols and cols[0] == "shelf" and "w" in frame.columns:
            sent.append(frame.count())
        return real(frame, *cols)

    monkeypatch.setattr(type(df), "groupBy", seen)
    monkeypatch.setattr(ni, "TILE_ROWS", 200)
    found = got(ni.knn_index(df, 3, probes=24, lists=24))
    assert max(sent) <= 600 * 8 and found == plain([(i, x) for i, x in enumerate(m)])  # once a list were 600 * 24
