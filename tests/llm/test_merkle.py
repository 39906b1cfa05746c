"""The manifest against a plain tree, over many shapes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from caselattice.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, p long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def record(r):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """The root, and for each leaf its steps (left, right)."""
    level, at, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k // 8 * 8
            steps[i].append(("".join(level[run:k]), "".join(level[k + 1:run + 8])))
            at[i] = k // 8
        level = [h(*level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0], steps


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root of the row without capitals) of every row."""
    none_first = lambda v: (v is not None, v or 0)
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    parts = {g: sorted((r for r in rows if r["lang"] == g), key=lambda r: (none_first(r["doc_id"]), record(r))) for g in langs}
    trees = {g: tree([record(r) for r in parts[g]]) for g in langs}
    root, tops = tree([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        for r, own in zip(parts[g], trees[g][1]):
            value = record(r | {"text": r["text"] and r["text"].lower()})
            for left, right in own + top:
                value = h(left, value, right)
            out.append((r["doc_id"], record(r), trees[g][0], root, h(*[a + b for a, b in own + top]), value))
    return sorted(out, key=repr)


def found(spark, rows, parts=3):
    df = spark.createDataFrame([r | {"tree": "x", "idx": 7, "p": 7} for r in rows], SCHEMA).repartition(parts)
    m = merkle.manifest(df, merkle.FIELDS, "lang", "doc_id", {"text": F.lower("text")})
    out = m.proved("copied", ["__order"]).select("__order", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return m, sorted((tuple(r) for r in out.collect()), key=repr)


def row(i, lang="en", text="A b"):
    return {"doc_id": i, "text": text, "lang": lang, "source": "s", "n_chars": 3}


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 1}, {"en": 9, None: 65, "é": 2}, {str(i): i % 3 + 1 for i in range(70)}])
def test_shapes(spark, sizes):
    """One leaf, whole and broken runs, more groups than a run; a null group; names ordered by their bytes."""
    rows = [row(100 * i, g) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows)[1] == plain(rows)


def test_more_than_a_block(spark):
    """4,097 leaves of a group: a second block of one leaf, so levels of one node that isn't hashed alone and of one that is."""
    rows = [row(i) for i in range(4097)] + [row(i, "de") for i in range(600)]
    assert found(spark, rows)[1] == plain(rows)


def test_nulls_ties_repeats(spark):
    """Null ids and fields, equal ids of different texts, equal rows, empty and long texts; clashing columns are left out."""
    rows = [row(None), row(None, None), row(1, text=None), row(1, text=""), row(1), row(1), row(1), row(2, text="Ä" * 300_000)]
    rows += [{"doc_id": 5, "text": None, "lang": "en", "source": None, "n_chars": None}]
    assert found(spark, rows)[1] == plain(rows)


def test_empty(spark):
    m, out = found(spark, [])
    assert out == [] and m.root() is None


def test_layout_makes_no_difference(spark):
    rows = [row(i, "ab"[i % 7 > 0], f"T{i}") for i in range(900)]
    assert found(spark, rows, 1)[0].root() == found(spark, rows, 13)[0].root() == plain(rows)[0][3]


def test_no_two_records_run_together(spark):
    rows = spark.createDataFrame([("1:a", "-"), ("1:a", None), ("", "1:a-"), (None, "1:a")], "a string, b string")
    assert rows.select(merkle.leaf(F.col("a"), F.col("b"))).distinct().count() == 4


def test_any_order_of_unions():
    """The forest gives the same nodes whatever the order and the grouping of what is put together."""
    leaves = [(0, 100, 0, i, h(str(i))) for i in range(100)] + [(1, 3, 0, i, h("x", str(i))) for i in range(3)]

    def nodes(parts):
        done, fragments = set(), []
        for part in parts:
            f = merkle.Forest(2)
            done |= {n for x in part for n in f.put(*x)}
            fragments.append(list(f.open()))
        last = merkle.Forest(2)
        done |= {n for part in fragments for x in part for n in last.put(*x)}
        assert not list(last.open())
        return done

    rng = random.Random(3)
    want = nodes([leaves])
    for _ in range(5):
        rng.shuffle(leaves)
        assert nodes([leaves[:40], leaves[40:41], [], leaves[41:]]) == want


def test_open_nodes_stay_few():
    """A partition's run of 100,000 leaves leaves open what lies at its ends only."""
    f = merkle.Forest(1)
    for i in range(12_345, 112_345):
        for _ in f.put(0, 10**9, 0, i, "0"):
            pass
    assert len(list(f.open())) < 150
