"""Streams that restart or come second, names at the threshold, separators, term rounds, answers of a namer."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselattice.operators import taxonomy, text_naming
from caselattice.plans import compile as plan
from caselattice.sources import store as stores
from caselattice.sources import tabular
from caselattice.streaming.learning import learn_stream

TAUGHT = "label string, v array<double>"


def run(spark, s, tmp_path, name, checkpoint):
    learn_stream(spark.readStream.schema(TAUGHT).parquet(str(tmp_path / name)), s, str(tmp_path / checkpoint)).awaitTermination()


def test_a_second_stream_counts_too(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "store"))
    for name, label, n in (("one", "A", 3), ("two", "B", 5)):
        spark.createDataFrame([(label, [1.0, 0.0])] * n, TAUGHT).write.parquet(str(tmp_path / name))
        run(spark, s, tmp_path, name, f"cp-{name}")
        run(spark, s, tmp_path, name, f"cp-{name}")
    assert stores.summary(s)["taxonomy"] == {"A": 3, "B": 5}
    s.learn(spark.createDataFrame([("A", [1.0, 0.0])], TAUGHT))
    run(spark, s, tmp_path, "one", "cp-one")
    assert stores.summary(s)["taxonomy"] == {"A": 4, "B": 5} and len(s.marks("label_centroids")) == 2


def test_a_crash_after_the_sums_does_not_count_twice(spark, tmp_path, monkeypatch):
    s = stores.Store(spark, str(tmp_path / "store"))
    spark.createDataFrame([("A", [1.0, 0.0])] * 3, TAUGHT).write.parquet(str(tmp_path / "in"))
    done = s.commit
    monkeypatch.setattr(s, "commit", lambda change: (done(change), 1 / 0))  # the log is a part of the commit, so the crash comes after both
    with pytest.raises(Exception):
        run(spark, s, tmp_path, "in", "cp")
    monkeypatch.undo()
    run(spark, s, tmp_path, "in", "cp")
    assert stores.summary(s)["taxonomy"] == {"A": 3}


def test_names_by_fingerprint_without_direction_and_unrounded(spark):
    at = lambda c: [c, (1 - c * c) ** 0.5, 0.0]
    groups = spark.createDataFrame([(0, "f0", [0.0, 0.0, 0.0]), (1, "f1", at(0.91996)), (2, "f2", [0.0, 0.0, 1.0])], "cluster int, fingerprint string, v array<double>")
    stored = spark.createDataFrame([("zero", "f0", [0.0, 0.0, 0.0]), ("far", "x", [1.0, 0.0, 0.0]), ("same", "f2", [0.0, 0.0, 0.0])], "name string, fingerprint string, v array<double>")
    got = {r.cluster: tuple(r)[1:] for r in taxonomy.restore_names(groups, stored).collect()}
    assert got[0] == ("zero", "exact", 1.0, False) and got[2] == ("same", "exact", 1.0, False)
    assert got[1] == (None, None, 0.92, False)
    none = taxonomy.restore_names(groups, stored.limit(0)).collect()
    assert all(tuple(r)[1:] == (None, None, None, False) for r in none)


@pytest.mark.parametrize("header,sep", [
    ("a;b;c", ";"), ("a,b", ","), ("a\tb\tc", "\t"), ("a|b", "|"), ("only one column", ","), ("What happened, in words;Date;Ward", ";"), ('"x, y";"z"', ";"), ("", ","),
])
def test_separators(header, sep):
    assert tabular.separator(header) == sep


def test_windows_1252_without_a_session_setting(spark, tmp_path):
    rows = "\r\n".join(["Réf;Date;Case summary"] + [f"{i};01/02/2024;“caf€” – naïve… {i} {'x' * 50}" for i in range(30)])
    (tmp_path / "r.csv").write_bytes(rows.encode("cp1252"))
    df = tabular.read_tabular(spark, str(tmp_path / "r.csv"))
    assert df.columns == ["Réf", "Date", "Case summary"] and df.first()["Case summary"].startswith("“caf€” – naïve… 0")
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def one_by_one(rows):
    """The rule as stated: rows from the best on, each taken if its term is free, its group has room and holds no term within it."""
    free, own = {r[2] for r in rows}, {r[1]: [] for r in rows}
    for score, label, term, coverage in sorted(rows)[::-1]:
        clash = [t for t, _ in own[label] if t.find(term) >= 0 or term.find(t) >= 0]
        if term in free and not clash and len(own[label]) < 8:
            own[label] += [(term, coverage)]
            free.remove(term)
    return own


def test_terms_in_rounds_against_one_by_one(spark):
    """Sixty sets of groups, each with letters of its own, settled together."""
    rng, every, want = random.Random(8), [], {}
    for case in range(60):
        words = [chr(0x4E00 + 20 * case + k) * 2 for k in range(rng.randint(3, 14))]
        pool = words + [f"{a} {b}" for a in words for b in words[:4]]
        rows = {(label, t): (round(rng.random(), 2), 10 * case + label, t, 0.5) for label in range(rng.randint(1, 6)) for t in rng.sample(pool, rng.randint(1, len(pool)))}
        every += rows.values()
        want |= {label: own for label, own in one_by_one(list(rows.values())).items() if own}
    df = spark.createDataFrame(every, "score double, label int, term string, coverage double")
    got = {}
    for r in sorted(text_naming.assign_terms(df).collect(), key=lambda r: (r.score, r.term), reverse=True):
        got.setdefault(r.label, []).append((r.term, r.coverage))
    assert got == want
    assert text_naming.assign_terms(df.where("false")).collect() == []


def test_answers_are_cleaned_and_asked_twice(spark):
    seen = []

    def namer(texts, avoid):
        seen.append(set(avoid))
        return '"Theatre delays."\nmore' if not avoid else "Late theatre lists"

    assert plan._asked(spark, namer, ["x"], set()) == "Theatre delays"
    assert plan._asked(spark, namer, ["x"], {"theatre delays"}) == "Late theatre lists" and seen[-1] == {"theatre delays"}
    assert plan._asked(spark, lambda t, a: "As an AI I cannot", ["x"], set()) is None and plan._asked(spark, lambda t, a: 1 / 0, ["x"], set()) is None


def test_padded_words_are_whole_words(spark):
    docs = spark.createDataFrame([(1, 0, "Alpha beta, gamma  delta\nalpha-beta"), (2, 0, "alphabet a"), (3, 0, None), (4, 0, "")], "id long, label int, text string")
    wanted = spark.createDataFrame([(0, t) for t in ("alpha", "alpha beta", "beta gamma", "gamma delta", "delta")], "label int, term string")
    got = {r.term: r.coverage for r in text_naming.term_coverage(docs, wanted).collect()}
    assert got == {"alpha": 0.25, "alpha beta": 0.25, "beta gamma": 0.0, "gamma delta": 0.0, "delta": 0.25}


def test_centroid_sims_against_numpy(spark):
    from caselattice.operators import similarity

    rng = np.random.default_rng(1)
    m, bank = rng.normal(size=(50, 6)), rng.normal(size=(9, 6))
    bank /= np.linalg.norm(bank, axis=1)[:, None]
    m[3] = 0
    v = spark.createDataFrame([(i, i % 11, x.tolist()) for i, x in enumerate(m)], "id long, label int, v array<double>")
    b = spark.createDataFrame([(c, x.tolist()) for c, x in enumerate(bank)], "c int, v array<double>")
    got = similarity.centroid_sims(v, b, 3, "label").collect()
    length = np.linalg.norm(m, axis=1)
    want = np.round((m / np.where(length, length, 1)[:, None]) @ bank.T, 9)
    for r in got:
        assert [s.c for s in r.sims] == np.argsort(-want[r.id], kind="stable")[:3].tolist()
        assert (r.own_sim is None) == (r.label > 8) and (r.label > 8 or abs(r.own_sim - want[r.id, r.label]) < 1e-9)
        assert r.rival.c == next(c for c in np.argsort(-want[r.id], kind="stable") if c != r.label)
    empty = similarity.centroid_sims(v, b.limit(0), 2, "label").collect()
    assert all(r.sims == [] and r.own_sim is None and r.rival is None for r in empty)


def test_kmeans_fits_together_against_numpy(spark):
    from caselattice.operators import clustering

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 3)) + 7 * np.eye(3)[c] for c in range(3)])
    w = rng.integers(1, 4, len(x)).astype(float)
    points = spark.createDataFrame([(i, v.tolist(), float(u)) for i, (v, u) in enumerate(zip(x, w))], "id long, space array<double>, w double").repartition(5).cache()
    placed, centres, cost = clustering.kmeans(points, 3, 6, weight="w")
    own = {r.id: r.cluster for r in placed.collect()}
    c = np.array(centres)
    far = ((x[:, None] - c[None]) ** 2).sum(2)
    assert [own[i] for i in range(len(x))] == far.argmin(1).tolist() and abs(cost - (far.min(1) * w).sum()) < 1e-6
    for q in range(3):  # a fixed point: each centre is its members' mean
        at = far.argmin(1) == q
        assert np.abs(c[q] - (x[at] * w[at, None]).sum(0) / w[at].sum()).max() < 1e-3
    assert all(len({own[i] for i in range(60 * q, 60 * q + 60)}) <= 2 for q in range(3)) and cost <= clustering.kmeans(points, 3, 1, weight="w")[2] + 1e-9
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, space array<double>")
    assert clustering.kmeans(same, 3, 2)[2] == 0.0
    assert clustering.kmeans(same.limit(0), 3, 2)[0].count() == 0
