"""Rows repeated many times, many sources, long lengths: no task or driver holds them all, and results stay exact."""

import random
from collections import Counter

import numpy as np
import pytest

from caselattice.functions import tables
from caselattice.llm import common, mixing, packing, sharding


@pytest.fixture
def hot(spark):
    rows = [(7, "the same words in every row", "a")] * 3000 + [(i, f"row {i} " + "w " * (i % 50), "ab"[i % 2]) for i in range(800)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)


def test_told_apart(spark, hot):
    base = common.written(common.numbered_rows(hot.select("doc_id", common.content_hash(hot, 1).alias("dice"))), "base")
    got = common.told_apart(base, 100).collect()
    assert len(got) == 3800 and len({r.dice for r in got}) == 3800 and sum(r.doc_id == 7 for r in got) == 3001
    other = common.written(common.numbered_rows(base.select("doc_id", "dice").repartition(3)), "base")
    assert {r.dice for r in common.told_apart(other, 100).collect()} == {r.dice for r in got}
    assert common.told_apart(base, 5000) is base


def test_starts(spark):
    counts = spark.createDataFrame([(k, k % 7 + 1) for k in range(100)], "b long, n long")
    got = {r.b: r.start for r in common.starts_of(counts, "b", group=8).collect()}
    assert got == {k: sum(j % 7 + 1 for j in range(k)) for k in range(100)}


def test_sharding_spreads_repeated_rows(spark, hot):
    got = sharding.sharded(hot, 40).select("rec.doc_id", "shard", "slot").collect()
    per = Counter(r.shard for r in got)
    assert len(got) == 3800 and max(per.values()) - min(per.values()) <= 1
    assert max(Counter(r.shard for r in got if r.doc_id == 7).values()) < 95  # all of a shard, if they lay side by side
    again = sharding.sharded(hot.repartition(2), 40).select("rec.doc_id", "shard", "slot").collect()
    assert Counter(again) == Counter(got)


def test_mixing_many_sources_without_broadcast(spark, hot, monkeypatch):
    monkeypatch.setattr(tables, "MOST_BROADCAST", 0)
    monkeypatch.setattr(mixing, "LEAF", 50)
    rng = random.Random(3)
    more = spark.createDataFrame([(i, "w " * rng.randint(0, 9), f"s{rng.randrange(300)}") for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix_plan(hot.unionByName(more)).collect()
    sizes, taken, most, target = Counter(), Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        most[r.source] = max(most[r.source], r.size)
        target[r.source] = r.target
    from test_text_ops import brute_targets
    want = brute_targets(sizes)
    assert len(want) > 290 and all(abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - want[s]) <= most[s] for s in want)


def simple_cost(lengths, counts, k):
    m = len(lengths)
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = lengths * c[1:] - s[1:]
    for _ in range(1, k):
        best = np.array([min([best[j], *(best[i] + lengths[j] * (c[j + 1] - c[i + 1]) - (s[j + 1] - s[i + 1]) for i in range(j))]) for j in range(m)])
    return best[-1]


@pytest.mark.parametrize("n,k,top", [(300, 16, 20_000), (57, 5, 1 << 40), (400, 3, 401), (40, 40, 5000)])
def test_best_ends_over_long_lengths(n, k, top):
    rng = np.random.default_rng(n)
    lengths = np.unique(rng.integers(1, top, n))
    counts = rng.integers(1, 1000, len(lengths))
    ends = packing.best_ends(lengths, counts, k)
    cost = sum(int(c) * (min(e for e in ends if e >= x) - int(x)) for x, c in zip(lengths, counts))
    assert len(ends) <= k and ends[-1] == lengths[-1] and cost == pytest.approx(simple_cost(lengths, counts, k), rel=1e-12)


def test_packing_above_a_thousand_tokens(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 500)
    rng = random.Random(5)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(1000, 6000), 2003]) for _ in range(3000)]
    docs = spark.createDataFrame([(n,) for n in lengths] + [(1777,)] * 1500 + [(None,), (0,), (-5,)], "len long")
    got = packing.packed(docs, length=packing.F.col("len"), n_buckets=8, token_budget=20_000).collect()
    each = Counter(lengths + [1777] * 1500)
    own, counts = (np.array(x) for x in zip(*sorted(each.items())))
    assert sum(r.padding for r in got) == simple_cost(own, counts, 8)
    assert {r.bucket_len for r in got} <= {0, *each} and sum(r.bucket_len == 0 for r in got) == 3
    slots = Counter((r.bucket, r.batch, r.slot) for r in got)
    assert max(slots.values()) == 1 and len(got) == 4503
