"""The operators on texts against brute force on small tables with nulls, empty texts, copies and ties."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from caselattice.llm import line_dedup, mixing, ngram_join, packing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, n_words string, batch string"


def table(spark, rows):
    """Extra columns clash with names that operators add."""
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "gamma", "déjà", "ÜBER", "e", "zeta", "a$b", "#x", "nu"]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    shared = [line(12) for _ in range(4)]
    out = [(0, None, None), (1, "", "a"), (2, " \t\n\x0b ", None), (3, "one", "a"), (4, "One", "b"), (5, "one two three", "b"), (6, "\n\n", "a")]
    for i in range(7, 60):
        parts = [line(rng.randint(1, 14)) for _ in range(rng.randint(1, 9))] + rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(parts)
        out.append((i, ("\n" if i % 7 else "\r\n").join(parts), rng.choice(["a", "a", "a", "b", None, "ü"])))
    base = " ".join(f"w{k}" for k in range(120))
    for i in range(60, 75):
        w = base.split()
        for _ in range(i - 60):
            w[rng.randrange(120)] = f"r{rng.random()}"
        out.append((i, " ".join(w), "c"))
    out += [(i, base.upper() if i % 2 else base, "c") for i in range(75, 80)]
    out.append((80, "\t" + shared[0].upper() + "  ", "a"))
    out.append((81, " ".join(f"long{k % 3000}" for k in range(30_000)), "b"))
    return out


def test_sharding(spark, rows):
    got = sharding.sharded(table(spark, rows + rows[:3]), 7, bucket_bytes=2000).select("rec.doc_id", "rec.text", "rec_size", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows + rows[:3])
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
        assert r.rec_size == len((r.text or "").encode()) + 16
    assert set(shards) == set(range(7))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    again = sharding.sharded(table(spark, rows + rows[:3]), 7, bucket_bytes=2000).select("rec.doc_id", "rec.text", "rec_size", "shard", "slot").collect()
    assert Counter(got) == Counter(again)
    assert sharding.sharded(table(spark, rows).limit(0), 7).count() == 0
    order = [(r.shard, r.slot, r.doc_id) for r in got]
    assert [x[2] for x in sorted(order)] != sorted((r.doc_id for r in got))


def test_few_rows_over_many_shards(spark, rows):
    got = sharding.sharded(table(spark, rows[:3]), 40).select("shard", "slot").collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0), (2, 0)]


def test_write_shards(spark, rows, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.sharded(table(spark, rows), 5), path)
    back = spark.read.parquet(path)
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 5


def brute_measures(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for s in t.split("\n"):
        if WORD.search(s):
            dup += s in seen
            seen.add(s)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_measures(spark, rows):
    for keep_text in (False, True):
        got = {r.doc_id: r for r in quality_rules.quality_rules(table(spark, rows), keep_text=keep_text).collect()}
        assert len(got) == len(rows)
        for i, t, _ in rows:
            want = brute_measures(t)
            r = got[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(table(spark, rows).limit(0)).count() == 0


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, "spam $$$", "spam") for i in range(200)] + [(2000, good, "spam"), (2001, good, None)]
    rows += [(3000 + i, good if i else "short", f"h{i % 9}") for i in range(90)]
    docs = table(spark, rows)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(got[i].kept for i in range(200)) and got[2001].kept and not got[2000].kept and got[2000].host_rejected
    assert sum(r.kept for r in got.values()) == 200 + 1 + 89
    verdicts = quality_rules.host_verdicts(quality_rules.with_measures(docs))
    assert {r.host: r.host_rejected for r in verdicts.collect()}["spam"]
    old, quality_rules.MOST_BROADCAST = quality_rules.MOST_BROADCAST, 0
    try:  # many rejected hosts: the salted join
        salted = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    finally:
        quality_rules.MOST_BROADCAST = old
    assert salted == {i: r.kept for i, r in got.items()}


def test_beta_prior():
    # 200 hosts of 50 documents, rates from a beta of weight 20 around 0.2; and rates that differ by chance only
    rng = np.random.default_rng(1)
    for rates, least, most in ((rng.beta(4, 16, 200), 12, 32), (np.full(200, 0.2), 300, None)):
        x = rng.binomial(50, rates)
        spread = (50 * (x / 50 - x.sum() / 10_000) ** 2).sum()
        weight = quality_rules.beta_prior(200, 10_000, 200 * 2500, int(x.sum()), spread)
        assert weight is None or weight > least and (most is None or weight < most)
    assert quality_rules.beta_prior(5, 500, 50_000, 100, 0.0) is None and quality_rules.beta_prior(1, 10, 100, 5, 0.0) == 2.0


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    t, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return t | share
        for s in over:
            t[s] = 3.0 * sizes[s]
        left, free = sum(sizes.values()) - sum(t.values()), [s for s in free if s not in over]
    return t


def test_mixing(spark, rows):
    docs = table(spark, rows + rows[:2])
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows) + 2
    sizes, taken, most, target = Counter(), Counter(), Counter(), {}
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.copies <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        most[r.source] = max(most[r.source], r.size)
        target[r.source] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - want[s]) <= most[s]
        assert all(r.source_size == sizes[s] for r in got if r.source == s)
    assert Counter(got) == Counter(mixing.mix_plan(docs).collect())
    assert mixing.mixed(docs).count() == sum(r.copies for r in got)
    assert Counter(r.doc_id for r in mixing.mixed(docs).collect()) == sum((Counter({r.doc_id: r.copies}) for r in got), Counter())
    clash = mixing.mixed(docs.withColumnsRenamed({"n_words": "size", "batch": "copies"}))
    assert clash.columns == ["doc_id", "text", "source", "size", "copies"] and {r.size for r in clash.collect()} == {"x"}
    assert Counter(r.doc_id for r in mixing.mixed(docs.repartition(7)).collect()) == Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_mixing_without_words(spark):
    got = mixing.mix_plan(table(spark, [(1, None, "a"), (2, "", None), (3, " ", "a")])).collect()
    assert [(r.size, r.source_size, r.target, r.copies) for r in got] == [(0, 0, 0.0, 0)] * 3


def test_mixing_tree_has_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 10)
    monkeypatch.setattr(mixing, "FANIN", 3)
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 30)), rng.choice("aaab")) for i in range(600)]
    got = mixing.mix_plan(table(spark, rows)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 30


def test_pivot_keeps_expectation():
    import numpy as np

    rng, total = np.random.default_rng(1), np.zeros(5)
    p, w = np.array([0.3, 0.6, 0.1, 0.9, 0.5]), np.array([3.0, 1, 4, 1, 5])
    for _ in range(4000):
        q, at = mixing.pivot(p, w, rng.random(5))
        assert abs((q * w).sum() - (p * w).sum()) < 1e-9
        assert all(x in (0, 1) for i, x in enumerate(q) if i != at)
        total += q
    assert abs(total / 4000 - p).max() < 0.04


def brute_lines(rows):
    key = lambda s: s.translate(A_Z).strip(" \t\n\x0b\x0c\r")
    holders = defaultdict(set)
    for i, t, _ in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 40:
                holders[key(s)].add(i)
    out = {}
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (len(key(s)) >= 40 and len(holders[key(s)]) >= 5 and i < max(holders[key(s)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark, rows):
    want = brute_lines(rows)
    for batches, fanin in ((1, 2), (5, 2)):
        got = line_dedup.line_dedup(table(spark, rows), n_batches=batches, fanin=fanin).collect()
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == want
    assert any(w[1] for w in want.values())
    assert line_dedup.line_dedup(table(spark, rows).limit(0)).count() == 0


def test_line_dedup_null_ids(spark):
    line = "the same line of more than forty characters, yes"
    got = line_dedup.line_dedup(table(spark, [(None, line, "a")] * 3 + [(1, line, "a"), (2, line, "a"), (2, line + "\nx", "a")])).collect()
    assert Counter((r.doc_id, r.n_dropped) for r in got) == Counter({(None, 1): 3, (1, 1): 1, (2, 0): 2})
    alone = line_dedup.line_dedup(table(spark, [(None, line, "a")] * 6)).collect()
    assert all(r.n_dropped == 0 for r in alone)


def test_line_runs_feed(spark):
    runs = line_dedup.LineRuns(fanin=2)
    lines = [f"line number {k} is long enough to be compared here" for k in range(6)]
    docs = lambda ks, i: table(spark, [(i, "\n".join(lines[k] for k in ks), "a")])
    fresh = [runs.dedup_batch(line_dedup.line_entries(docs(ks, i))).count() for i, ks in enumerate([[0, 1], [1, 2], [0, 2, 3], [3, 4, 5], [5]])]
    assert fresh == [2, 1, 1, 2, 0]
    assert len(runs.levels) >= 3 and runs.merged().count() == 6


def brute_ends(lengths, counts, k):
    best = None
    n = len(lengths)
    for cuts in product([0, 1], repeat=n - 1):
        if sum(cuts) + 1 > k:
            continue
        ends = [i for i, c in enumerate(cuts) if c] + [n - 1]
        cost = sum(counts[i] * (lengths[next(e for e in ends if e >= i)] - lengths[i]) for i in range(n))
        best = cost if best is None else min(best, cost)
    return best


def test_best_ends():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, k in ((1, 3), (5, 1), (7, 3), (9, 4), (10, 10), (10, 2)):
        lengths = np.sort(rng.choice(np.arange(1, 100), n, replace=False))
        counts = rng.integers(1, 50, n)
        ends = packing.best_ends(lengths, counts, k)
        cost = sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))
        assert len(ends) <= k and cost == brute_ends(lengths.tolist(), counts.tolist(), k)


def test_packing(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 9)
    got = packing.packed(table(spark, rows), n_buckets=4, token_budget=300).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _, _ in rows]
    batches = defaultdict(list)
    for r in got:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    last = {b: max(k for c, k in batches if c == b) for b, _ in batches}
    for (b, k), own in batches.items():
        room = max(1, 300 // max(own[0].bucket_len, 1))
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= room
        assert k == last[b] or len(own) == room
    assert packing.packed(table(spark, rows).limit(0)).count() == 0


def brute_components(rows, width, percent):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(A_Z))
        sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in ids[x + 1:]:
            a, b = sets[ids[x]], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(ids[x]), find(y)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components(spark, rows, width, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    got = ngram_join.jaccard_components(table(spark, rows), width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, width, percent)


def test_jaccard_random_near_copies(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(rng.choice([3, 8, 20, 60, 200]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w), "s"))
    rng.shuffle(rows)
    got = ngram_join.jaccard_components(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 85)


def test_jaccard_nulls_and_repeats(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = table(spark, [(None, t, "a"), (3, t, "a"), (3, t, "a"), (5, t, "a"), (6, None, "a"), (7, "", "a")])
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert got == Counter({(None, None): 1, (3, 3): 2, (5, 3): 1, (6, 6): 1, (7, 7): 1})
    kept = ngram_join.one_of_each(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept) == [-1, 3, 6, 7]
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 30)}


def test_query_digests(spark, rows, tmp_path):
    table(spark, rows).select("doc_id", "text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    two = {r.doc_id: r for r in sharding.op2_sharding(spark, d).collect()}
    assert all(two[i].text_crc32 == zlib.crc32((t or "").encode()) and two[i].law == "rows" for i, t, _ in rows)
    five = {r.doc_id: r.kept_sha256 for r in line_dedup.op5_line_dedup(spark, d).collect()}
    assert five == {i: hashlib.sha256(w[2].encode()).hexdigest() for i, w in brute_lines(rows).items()}
    four = mixing.op4_mixing(spark, d).collect()
    assert all(r.taken <= 3 * r.size for r in four)
