"""Commits of the store: writers at the same time, failures between steps, repeats, merged parts."""

import threading

import pytest
from pyspark.sql import functions as F

from caselattice.sources import store as stores
from caselattice.streaming.learning import learn_stream

TAUGHT = "label string, v array<double>"
RUN = {"source": "s", "k": 3, "n_cases": 2, "silhouette": 0.1, "shuffled": 0.0, "stability": 0.5, "agreement": 0.6, "chance": 0.2, "verdict": "weak"}


def together(*jobs):
    failed = []

    def run(job):
        try:
            job()
        except BaseException as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed, failed


def assigned(spark, keys):
    row = "cast(1 as int) cluster_id, 'L' label, 0.5D to_own, 0.4D to_next, 0.1D margin, 3 neighbours, false borderline, 'r' reason"
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, case_key string").selectExpr("*", *row.split(", "))


def test_writers_at_once_all_count(spark, tmp_path):
    root = str(tmp_path / "store")
    teach = lambda label, n: lambda: stores.Store(spark, root).learn(spark.createDataFrame([(label, [1.0, 0.0])] * n, TAUGHT))
    name = lambda k: lambda: stores.Store(spark, root).save_name([f"k{k}"], f"Name {k}", [1.0])
    run = lambda: stores.Store(spark, root).record_run(RUN, assigned(spark, ["a", "b"]))
    together(teach("A", 2), teach("A", 3), teach("B", 4), name(1), name(2), run, run)
    s = stores.Store(spark, root)
    assert stores.summary(s)["taxonomy"] == {"A": 5, "B": 4}
    assert {r["name"] for r in s.read("group_names").collect()} == {"Name 1", "Name 2"}
    assert sorted(r["run_id"] for r in s.read("runs").collect()) == [1, 2]
    assert sorted((r["run_id"], r["case_key"]) for r in s.read("assignments").collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert s.read("events").count() == 7


def test_two_streams_at_once(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "store"))
    for name, n in (("one", 3), ("two", 5)):
        for k in range(2):
            spark.createDataFrame([("A", [1.0, 0.0])] * n, TAUGHT).write.parquet(str(tmp_path / name / str(k)))
    stream = lambda name: lambda: learn_stream(spark.readStream.schema(TAUGHT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*")), s, str(tmp_path / f"cp-{name}")).awaitTermination()
    together(stream("one"), stream("two"))
    assert stores.summary(s)["taxonomy"] == {"A": 16} and len(s.marks("label_centroids")) == 2


def test_runs_and_assignments_come_or_fail_together(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "store"))
    broken = assigned(spark, ["a"]).withColumn("label", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        s.record_run(RUN, broken, token="t")
    assert s.read("runs").count() == s.read("assignments").count() == s.read("events").count() == 0
    assert s.record_run(RUN, assigned(spark, ["a", "a"]), token="t") == 1
    assert s.record_run(RUN, assigned(spark, ["a", "z"]), token="t") == 1  # a repeat is known
    assert [r["case_key"] for r in s.read("assignments").collect()] == ["a"] and s.read("runs").count() == 1
    assert s.record_run(RUN, assigned(spark, ["a"])) == 2


def test_a_commit_is_asked_again_on_the_new_state(spark, tmp_path):
    s, seen = stores.Store(spark, str(tmp_path / "store")), []

    def change(state):
        seen.append(state["number"])
        if len(seen) == 1:  # another writer comes first
            stores.Store(spark, s.root).log("other", {})
        return {"append": s.event("own", {})}

    s.commit(change)
    assert seen == [0, 1] and sorted(r["kind"] for r in s.read("events").collect()) == ["other", "own"]


def test_a_renamed_state_does_not_replace_another(spark, tmp_path):
    """The way of other file systems: a rename that fails where the number is taken."""
    s = stores.Store(spark, str(tmp_path / "store"))
    s.log("one", {})

    class Elsewhere:  # a file system whose scheme isn't file
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def getUri(self):
            class Uri:
                def __init__(self, uri):
                    self.uri = uri

                def getScheme(self):
                    return "other"

            return Uri(self.fs.getUri())

    plain = s._fs
    s._fs = lambda path: (plain(path)[0], Elsewhere(plain(path)[1]))
    real = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    assert real is not None
    state = s.state()
    s._context = lambda fs: real
    assert s._placed(state | {"number": 2}) and not s._placed(state | {"number": 2}) and not s._placed(state | {"number": 1})


def test_parts_are_merged_and_old_ones_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FAN_IN", 3)
    s = stores.Store(spark, str(tmp_path / "store"))
    for k in range(10):
        s.log("e", {"k": k})
    assert s.read("events").count() == 10
    assert sorted(level for _, level in s.state()["parts"]["events"]) == [0, 2]
    before = s.state()
    assert s.vacuum(hours=24) == 0 and s.vacuum(hours=-1) > 5
    assert s.read("events").count() == 10 and s.state() == before
