"""Merkle manifest of a dataset: a tree of digests for each group of records, and one over the groups' roots.

Partial trees are a sparse forest: a set of nodes, each with its tree, level and index, whose sibling runs are not complete
yet. Forests are a monoid. Putting two together unites their nodes, and a run whose known number of siblings is there becomes
its parent, again and again; the order of unions doesn't matter. Partitions of the sorted leaves make a forest each, whose open
nodes lie at its two ends only, so a forest is a few hundred nodes however many leaves it has. Forests meet in a tree of
rounds, FAN_IN neighbours in a task, and each round is written: a lost executor costs a part of one round, and neither the
driver nor any task holds more than the open nodes of FAN_IN forests.

Proofs go the other way. The nodes that end blocks of ARITY ** DEEP leaves get their siblings up to the root, level by level,
and each block's leaves get the rest in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rows import numbered
from .common import ascii_lower, documents, dropped, met, written

#: Children of a node; levels below which a block of leaves is one task's; forests that meet in a task.
ARITY, DEEP, FAN_IN = 8, 4, 32
#: The number of the tree over the groups' roots. Groups are trees 0, 1, ...
TOP = -1
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FOREST = "g long, tree long, size long, level int, idx long, digest string, open boolean"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of a record: every field as its bytes' number, ``:`` and its text; ``-`` for null. So no two records run together."""
    shown = [F.coalesce(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*shown), 256)


def width(size: int, level: int) -> int:
    """Nodes of a level over ``size`` leaves."""
    return -(-size // ARITY**level)


class Forest:
    """Nodes without their whole run. ``put`` takes one and returns those that are finished by it: (tree, size, level, idx, digest)."""

    def __init__(self, groups: int):
        self.groups, self.runs = groups, {}

    def put(self, tree: int, size: int, level: int, idx: int, value: str) -> Iterator[tuple]:
        while True:
            if width(size, level) == 1:  # a root
                yield tree, size, level, idx, value
                if tree == TOP:
                    return
                tree, size, level, idx = TOP, self.groups, 0, tree
                continue
            run = (tree, size, level, idx // ARITY)
            here = self.runs.setdefault(run, {})
            here[idx] = value
            if len(here) < min(ARITY, width(size, level) - run[3] * ARITY):
                return
            del self.runs[run]
            for i in sorted(here):
                yield tree, size, level, i, here[i]
            level, idx, value = level + 1, run[3], digest([here[i] for i in sorted(here)])

    def open(self) -> Iterator[tuple]:
        for (tree, size, level, _), here in self.runs.items():
            for i, value in here.items():
                yield tree, size, level, i, value


def _rows(g: int, found: list, open_: list) -> pd.DataFrame:
    """Finished nodes at the ends of blocks and above, and open ones."""
    high = [(g, *n, False) for n in found if n[0] == TOP or n[2] >= DEEP or width(n[1], n[2]) == 1]
    return pd.DataFrame(high + [(g, *n, True) for n in open_], columns=["g", "tree", "size", "level", "idx", "digest", "open"])


def forests(leaves: DataFrame, groups: int) -> DataFrame:
    """The forest of each partition of leaves (p, tree, size, idx, leaf), as rows of FOREST."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, g = Forest(groups), 0
        for b in batches:
            found = []
            for g, tree, size, idx, value in zip(b["p"], b["tree"], b["size"], b["idx"], b["leaf"]):
                found += forest.put(tree, size, 0, idx, value)
            yield _rows(g, found, [])
        yield _rows(g, [], list(forest.open()))

    return leaves.select("p", "tree", "size", "idx", "leaf").mapInPandas(run, FOREST)


def tree_reduced(fragments: DataFrame, groups: int) -> list[DataFrame]:
    """The tables of all rounds: neighbouring forests meet until nothing is open."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        forest, found = Forest(groups), []
        for node in rows[["tree", "size", "level", "idx", "digest"]].itertuples(index=False, name=None):
            found += forest.put(*node)
        return _rows(int(key[0]), found, list(forest.open()))

    here, done = written(fragments, "forests"), []
    while True:
        done.append(here)
        left = here.where("open")
        if left.isEmpty():
            return done
        here = written(left.groupBy(F.floor(F.col("g") / FAN_IN).alias("g")).applyInPandas(merge, FOREST), "forests")


def indexed(leaves: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, int, DataFrame]:
    """leaves with p (partition), tree (its group's place among all, null first), size (leaves of it) and idx in it; the number of groups; the groups.

    Sorted by range, numbered inside the partitions, and moved on by the counts of the partitions before; equal rows take any
    order among them, so ``rid`` spreads them. A hot group is many partitions.
    """
    # a retried task of a sort must see the same input, so it is written first
    base = written(leaves.withColumn("rid", F.monotonically_increasing_id()), "leaves")
    sizes = base.groupBy(group).agg(F.count("*").alias("size"))
    trees = written(numbered(sizes.orderBy(F.col(group).asc_nulls_first()), "tree").withColumn("tree", F.col("tree") - 1), "trees")
    at = base.orderBy(F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], "rid").drop("rid")
    at = at.withColumns({"p": F.spark_partition_id().cast("long"), "i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    at = written(at, "sorted")
    counts = at.groupBy("p", group).agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = Window.partitionBy(group).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("p", group, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    known = trees.select(F.col(group).alias("__g"), "tree", "size")
    starts = starts.join(known, F.col(group).eqNullSafe(F.col("__g"))).select(F.struct("p", F.col(group).alias("g")).alias("at"), "tree", "size", "start")
    out = met(at.withColumn("at", F.struct("p", F.col(group).alias("g"))), written(starts, "starts"), "at")
    return out.withColumn("idx", F.col("start") + F.col("i")).drop("at", "start", "i"), trees.count(), trees


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, size, level, idx, path) of the nodes that end blocks: for each level up to the root the siblings to the left and to the right.

    Level by level from the root down; a node's path is its own siblings and its parent's path. What is joined is one row a
    block and less above.
    """
    run = (F.col("idx") / ARITY).cast("long")
    runs = nodes.groupBy("tree", "level", run.alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("all"))
    beside = lambda keep: F.array_join(F.transform(F.filter("all", keep), lambda x: x["digest"]), "")
    own = F.struct(beside(lambda x: x["idx"] < F.col("idx")).alias("left"), beside(lambda x: x["idx"] > F.col("idx")).alias("right"))
    sided = nodes.withColumn("run", run).join(runs, ["tree", "level", "run"])
    sided = written(sided.select("tree", "size", "level", "idx", "run", F.array(own).alias("own")), "sided")
    top = sided.where(F.col("tree") == TOP).agg(F.max("level")).first()[0]
    if top is None:  # no leaves
        return sided.select("tree", "size", "level", "idx", F.col("own").alias("path"))
    none = F.array().cast(sided.schema["own"].dataType)
    # the root over the groups, then down
    here = sided.where((F.col("tree") == TOP) & (F.col("level") == top)).select("tree", "size", "level", "idx", none.alias("path"))
    for level in range(top - 1, -1, -1):
        above = here.select(F.col("idx").alias("run"), "path")
        below = sided.where((F.col("tree") == TOP) & (F.col("level") == level))
        here = written(below.join(above, "run").select("tree", "size", "level", "idx", F.concat("own", "path").alias("path")), "paths")
    roots = here.select(F.col("idx").alias("tree"), "path")
    heads = sided.where(F.col("tree") != TOP).groupBy("tree").agg(F.max("level").alias("level"))
    heads = written(heads.join(roots, "tree"), "heads")
    highest = heads.agg(F.max("level")).first()[0]
    done, here = [], None
    for level in range(highest, -1, -1):
        # roots of this level, and children of what is one level higher
        now = sided.where((F.col("tree") != TOP) & (F.col("level") == level))
        head = now.join(heads.where(F.col("level") == level).select("tree", "path"), "tree").select("tree", "size", "level", "idx", "path")
        if here is not None and level >= DEEP:
            above = here.select("tree", F.col("idx").alias("run"), "path")
            head = head.unionByName(now.join(above, ["tree", "run"]).select("tree", "size", "level", "idx", F.concat("own", "path").alias("path")))
        here = written(head, "paths")
        if level <= DEEP:
            done.append(here)
    return reduce(DataFrame.unionByName, done)


def climb(value: str, path: list) -> str:
    """The root that a digest and the siblings on its way give."""
    for step in path:
        value = digest([step["left"], value, step["right"]])
    return value


class Manifest:
    """A dataset's leaves, finished nodes and roots, with proofs of any copy of its leaves."""

    def __init__(self, leaves: DataFrame, group: str, order: list[str]):
        self.leaves, self.groups, self.trees = indexed(leaves, group, order)
        done = tree_reduced(forests(self.leaves, self.groups), self.groups)
        nodes = reduce(DataFrame.unionByName, done).where("not open")
        self.nodes = written(nodes.select("tree", "size", "level", "idx", "digest"), "nodes")
        dropped(*done)

    def root(self) -> str | None:
        """One digest; null for a dataset without rows."""
        top = self.nodes.where(F.col("tree") == TOP).orderBy(F.desc("level")).select("digest").first()
        return top["digest"] if top else None

    def proved(self, copy: str, keep: list[str]) -> DataFrame:
        """keep, with leaf, subroot, root, proof_sha256 (of all siblings up to the root) and folded_root: the root that the leaves in column ``copy`` give with them."""
        root = self.root()
        head = Window.partitionBy("tree")
        subroots = self.nodes.where(F.col("tree") != TOP).withColumn("top", F.max("level").over(head)).where("level = top").select("tree", F.col("digest").alias("subroot"))
        ends = paths(self.nodes).join(subroots, "tree").withColumnRenamed("idx", "block")
        leaves = self.leaves.withColumn("block", (F.col("idx") / ARITY**DEEP).cast("long"))
        cols = [*keep, "leaf", "subroot", "root", "proof_sha256", "folded_root"]
        kinds = {c: t for c, t in self.leaves.dtypes} | {c: "string" for c in cols[len(keep):]}

        def run(rows: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
            rows, end = rows.sort_values("idx"), end.iloc[0]
            above = list(end["path"])
            upper = "".join(s["left"] + s["right"] for s in above)
            levels = [list(rows["leaf"])]
            for _ in range(int(end["level"])):
                here = levels[-1]
                levels.append([digest(here[i:i + ARITY]) for i in range(0, len(here), ARITY)])
            steps = []  # by level, the siblings of each node
            for here in levels[:-1]:
                starts = [i - i % ARITY for i in range(len(here))]
                steps.append([{"left": "".join(here[s:i]), "right": "".join(here[i + 1:s + ARITY])} for i, s in enumerate(starts)])
            proofs, folded = [], []
            for i, value in enumerate(rows[copy]):
                own, at = [], i
                for here in steps:
                    own.append(here[at])
                    at //= ARITY
                proofs.append(digest([s["left"] + s["right"] for s in own] + [upper]))
                folded.append(climb(value, own + above))
            out = rows[keep].copy()
            out["leaf"], out["subroot"], out["root"], out["proof_sha256"], out["folded_root"] = rows["leaf"], end["subroot"], root, proofs, folded
            return out[cols]

        both = leaves.groupBy("tree", "block").cogroup(ends.groupBy("tree", "block"))
        return both.applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols))


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, copy: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs: leaves of ``fields``, trees by ``group``, leaves in order of the column ``order``, null first, ties by their digest.

    copy: other values of fields, for a second leaf a row (``copied``), as of a dataset that was changed. Null fields are ``-``; texts of
    any length are taken whole; equal rows are leaves of equal digests, side by side. An empty table has no root and no rows.
    Other columns of docs, of any name, are left out.
    """
    own = [F.col(f) for f in fields]
    other = [(copy or {}).get(f, F.col(f)) for f in fields]
    same = leaf(*own)
    changed = F.lit(False)
    for f in copy or {}:
        changed = changed | ~F.col(f).eqNullSafe(copy[f])
    leaves = docs.select(F.col(order).alias("__order"), F.col(group).alias("__group"), same.alias("leaf"), F.when(changed, leaf(*other)).alias("copied"))
    return Manifest(leaves.withColumn("copied", F.coalesce("copied", "leaf")), "__group", ["__order", "leaf"])


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and the root folded from a copy in which a third of the texts lost their capitals."""
    docs = documents(spark, sf_dir).select(*FIELDS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    out = manifest(docs, FIELDS, "lang", "doc_id", {"text": tampered}).proved("copied", ["__order"])
    return out.withColumnRenamed("__order", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(most: int = 10) -> str:
    """The same trees in SQL, level by level to ``most``."""
    # crc32 of a few digits, bit by bit
    table = "list_transform(range(256), lambda v: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, v))"
    crc = "xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda ch: unicode(ch)::bigint), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::bigint), 4294967295)"
    shown = lambda c: f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
    rec = lambda text: "sha256(" + " || ".join(shown(text if f == "text" else f) for f in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"crc as (select {table} as t)",
        f"base as (select doc_id, lang, {rec('text')} as leaf, case when ({crc}) % 3 = 0 then {rec(lower)} else {rec('text')} end as copied from documents, crc)",
        "a0 as (select *, lang as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, leaf as digest from base)",
        "n0 as (select tree, idx, digest from a0)",
    ]

    def levels(p: str) -> None:
        for k in range(1, most + 1):
            out.append(
                f"{p}{k} as (select tree, idx // 8 as idx, case when (select count(*) from {p}{k - 1} z where z.tree is not distinct from y.tree) > 1"
                f" then sha256(string_agg(digest, '' order by idx)) else min(digest) end as digest from {p}{k - 1} y group by tree, idx // 8)"
            )

    levels("n")
    out.append(f"r0 as (select 0 as tree, row_number() over (order by tree nulls first) - 1 as idx, digest, tree as lang from n{most})")
    levels("r")
    for p in "nr":
        for k in range(most):
            window = lambda frame: f"coalesce(string_agg(digest, '') over (partition by tree, idx // 8 order by idx rows between {frame}), '')"
            out.append(f"{p}s{k} as (select tree, idx, {window('unbounded preceding and 1 preceding')} as l, {window('1 following and unbounded following')} as r, count(*) over (partition by tree) > 1 as many from {p}{k})")
    join = " ".join(f"join ns{k} on ns{k}.tree is not distinct from a0.tree and ns{k}.idx = a0.idx // {8 ** k}" for k in range(most))
    join += " join r0 on r0.lang is not distinct from a0.tree " + " ".join(f"join rs{k} on rs{k}.idx = r0.idx // {8 ** k}" for k in range(most))
    steps = [f"ns{k}" for k in range(most)] + [f"rs{k}" for k in range(most)]
    proof = " || ".join(f"{s}.l || {s}.r" for s in steps)
    out.append(f"f0 as (select a0.doc_id, a0.leaf, r0.digest as subroot, (select digest from r{most}) as root, sha256({proof}) as proof_sha256, a0.copied as c, [{', '.join(f'{{l: {s}.l, r: {s}.r, many: {s}.many}}' for s in steps)}] as path from a0 {join})")
    for k in range(1, len(steps) + 1):
        out.append(f"f{k} as (select * exclude (c), case when path[{k}].many then sha256(path[{k}].l || c || path[{k}].r) else c end as c from f{k - 1})")
    return f"with {', '.join(out)} select doc_id, leaf, subroot, root, proof_sha256, c as folded_root, c = root as verified from f{len(steps)}"


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE = {"op11_merkle_manifest": _sql(6)}
