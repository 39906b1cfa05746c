"""Runs that anti-join without a shuffle; overlaps counted by fragment; rows of one id."""

import random
from collections import Counter

from pyspark.sql import functions as F

from caselattice.functions import tables
from caselattice.llm import common, line_dedup, ngram_join

SCHEMA = "doc_id long, text string, source string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def entries(spark, n, step=1):
    key = F.col("id") % 300
    return spark.range(0, n, step).select("id", F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2"))


def test_runs_meet_without_a_shuffle_or_sort(spark):
    runs = line_dedup.LineRuns(fanin=3)
    a = runs.saved(line_dedup.counted(entries(spark, 2000)), "batch")
    b = runs.saved(line_dedup.counted(entries(spark, 900, 2)), "batch")
    runs.add(a)
    with common.one_use(spark, line_dedup.AS_RUNS):
        fresh = plan(runs.fresh(b))
        runs.add(b)
        merged = plan(runs.both(*runs.all()))
    assert "LeftAnti" in fresh and "Exchange" not in fresh and "Sort [" not in fresh
    assert "FullOuter" in merged and "Exchange" not in merged and "Sort [" not in merged
    assert runs.merged().count() == 300 and runs.merged().agg(F.sum("n_docs")).first()[0] == 2000 + 450
    assert spark.conf.get(tables.CLEAN_UP) == "false"
    line_dedup.forgotten(*runs.all())


def test_the_anti_join_decides_where_a_line_stays(spark, monkeypatch):
    """Without it nothing goes: the operator takes the last holder from the batch in which a key is new."""
    line = "the same line of more than forty characters, yes"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}", "a") for i in range(20)], SCHEMA)
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(docs, n_batches=4).collect()}
    assert got == {i: int(i < 19) for i in range(20)}
    monkeypatch.setattr(line_dedup.LineRuns, "fresh", lambda self, run: run.limit(0))
    assert not any(r.n_dropped for r in line_dedup.line_dedup(docs, n_batches=4).collect())


def test_rows_of_one_id_are_one_document(spark):
    line = "the same line of more than forty characters, yes"
    rows = [(i, line, "a") for i in (1, 1, 1, 2, 3)]
    assert not any(r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    got = Counter((r.doc_id, r.n_dropped) for r in line_dedup.line_dedup(spark.createDataFrame(rows + [(4, line, "a"), (5, line, "a")], SCHEMA)).collect())
    assert got == {(1, 1): 3, (2, 1): 1, (3, 1): 1, (4, 1): 1, (5, 0): 1}


def test_ids_that_are_no_numbers(spark):
    line = "the same line of more than forty characters, yes"
    docs = spark.createDataFrame([(c, line) for c in "abcde"], "doc_id string, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(docs).collect()} == {c: int(c != "e") for c in "abcde"}


def test_partial_overlaps(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(40)], k=rng.randint(1, 300))) for _ in range(12)] + ["one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = common.written(ngram_join.gram_table(docs, "text", 2), "grams")
    ids = {r.set_id: r.grams for r in grams.groupBy("set_id").agg(F.flatten(F.collect_list("grams")).alias("grams")).collect()}
    assert grams.groupBy("set_id").count().where(f"count <> {ngram_join.PARTS}").isEmpty()
    pairs = [(a, b) for a in ids for b in ids if a < b]
    parts = ngram_join.partial_overlaps(spark.createDataFrame(pairs, "a long, b long"), grams).collect()
    assert len(parts) == len(pairs) * ngram_join.PARTS
    total = Counter()
    for r in parts:
        total[r.a, r.b] += r.o
    assert all(total[a, b] == len(set(ids[a]) & set(ids[b])) for a, b in pairs)
    bounds = [(1 << 64) // ngram_join.PARTS * k for k in range(1, ngram_join.PARTS)]
    for r in grams.collect():
        assert all(sum((g % (1 << 64)) >= x for x in bounds) == r.part for g in r.grams)


def test_one_row_of_a_repeated_id_whatever_the_layout(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(3, t, "a"), (3, t, "b"), (3, t, "b"), (3, "other " * 9, "c"), (5, t, "a"), (6, None, None), (None, t, "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [Counter(map(tuple, ngram_join.one_of_each(docs.repartition(n)).collect())) for n in (1, 3)]
    assert got[0] == got[1] and sum(got[0].values()) == 4 and Counter(r[0] for r in got[0].elements()) == {3: 2, 6: 1, None: 1}


def test_components_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_BROADCAST", 0)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 20)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100 + k: 100 for k in range(1, 20)}
