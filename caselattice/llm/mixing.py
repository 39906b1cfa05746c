"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; a document's expected number of copies is target / size of its source. The whole
part of it is certain, the fraction is rounded: two documents at a time, words are moved from one fraction to the
other, in a random direction that keeps both expectations, until one is 0 or 1. The sum of words never changes, so a
source ends within one document's size of its target. Each leaf (some thousand documents of one source) leaves at most
one fraction; leaves are combined by a tree of the same step, ``FANIN`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content_hash, documents, met, n_words, numbered_rows, told_apart, unit_hash, written

WEIGHTS = (5, 2, 1)
LEAF, FANIN = 2_000, 4_096
EDGE = 1e-12


def with_targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """sizes (source, size, n), one row a source, with ``num`` and ``den``: the target num / den of each source, exact.

    Sources by code point, null last, weigh ``weights`` in turn; none gets more than ``most`` times its size, and what is
    over is shared again by weight among the others. Two sums a round of sharing reach the driver, whatever the number
    of sources; sources get their turn from a sort and one count a partition.
    """
    ranked = written(numbered_rows(sizes.orderBy(F.col("source").asc_nulls_last())), "sources").withColumn("part", F.shiftright("rid", 33))
    starts, total = [], 0
    for r in ranked.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts += [total] * (r["part"] + 1 - len(starts))
        total += r["n"]
    place = F.get(F.lit(starts or [0]), F.col("part")) + F.col("rid").bitwiseAND((1 << 33) - 1)
    weight = F.get(F.lit(list(weights)), F.pmod(place, F.lit(len(weights))).cast("int"))
    rows = ranked.select("source", "size", "n", weight.cast("decimal(20,0)").alias("weight"), F.col("size").cast("decimal(20,0)").alias("whole"), F.lit(False).alias("full"))
    left = int(rows.agg(F.sum("whole")).first()[0] or 0)
    while True:
        open_ = rows.where(~F.col("full")).agg(F.sum("weight").alias("w")).first()["w"]
        share = F.lit(left).cast("decimal(20,0)") * F.col("weight")
        over = ~F.col("full") & (share >= F.lit(int(open_ or 1)).cast("decimal(18,0)") * (most * F.col("whole")))
        gone = rows.where(over).agg(F.sum(most * F.col("whole")).alias("s"), F.count("*").alias("n")).first()
        if not gone["n"]:
            break
        rows = written(rows.withColumn("full", F.col("full") | over), "sources")
        left -= int(gone["s"])
    num = F.when(F.col("full"), (most * F.col("whole"))).otherwise(share)
    return rows.select("source", "size", "n", num.cast("decimal(38,0)").alias("num"), F.when(F.col("full"), F.lit(1)).otherwise(F.lit(int(open_ or 1))).cast("long").alias("den"))


def pivot(p: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounded probabilities, and the place of the one that may be left fractional (-1: none). w: sizes over 0, u: uniform numbers."""
    p, at = p.tolist(), -1
    w, u = w.tolist(), u.tolist()
    for j in range(len(p)):
        if p[j] <= EDGE or p[j] >= 1 - EDGE:
            p[j] = float(round(p[j]))
            continue
        if at < 0:
            at = j
            continue
        up = min((1 - p[at]) * w[at], p[j] * w[j])  # words that may move to the first
        down = min(p[at] * w[at], (1 - p[j]) * w[j])
        move = up if u[j] * (up + down) < down else -down
        p[at] += move / w[at]
        p[j] -= move / w[j]
        done = [k for k in (at, j) if p[k] <= EDGE or p[k] >= 1 - EDGE]
        for k in done:
            p[k] = float(round(p[k]))
        at = -1 if len(done) == 2 else (j if done == [at] else at)
    return np.array(p, float), at


def _round_group(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", *keys], kind="stable", ignore_index=True)
        p, at = pivot(pdf["p"].to_numpy(), pdf["w"].to_numpy(), pdf["u2"].to_numpy())
        state = np.zeros(len(pdf), bool)
        if at >= 0:
            state[at] = True
        return pdf.assign(p=p, open=state)

    return run


def rounded(rows: DataFrame, seed: int) -> DataFrame:
    """rows (source, leaf, rid, dice, w long over 0, p double) with ``take`` 0 or 1: the tree of pivotal steps, of as many levels as it takes."""
    dice = lambda k: {"u": unit_hash(seed + k, F.col("source"), F.col("dice")), "u2": unit_hash(seed + 7919 + k, F.col("source"), F.col("dice"))}
    schema = "source string, leaf long, rid long, dice long, w long, p double, node long, open boolean"
    cols = ["source", "leaf", "rid", "dice", "w", "p", "node"]
    step = lambda df, k: df.withColumns(dice(k)).groupBy("source", "node").applyInPandas(
        lambda pdf: _round_group(["rid", "leaf"])(pdf)[[*cols, "open"]], schema)
    level, out, k = written(step(rows.withColumn("node", F.col("leaf")), 0), "leaves"), [], 0
    while True:
        out.append(level.where(~F.col("open")).select("rid", F.col("p").cast("int").alias("take")))
        left = level.where("open").select(*cols)
        if not left.groupBy("source").count().where("count > 1").limit(1).count():
            last = left.select("rid", (unit_hash(seed + 104729, F.col("source"), F.col("dice")) < F.col("p")).cast("int").alias("take"))
            break
        k += 1
        level = written(step(left.withColumn("node", F.floor(F.col("node") / FANIN)), k), f"level{k}")
    for part in out:
        last = last.unionByName(part)
    return last


def _planned(docs: DataFrame, carry: list[str], text_col: str, source_col: str, seed: int, most: int) -> DataFrame:
    """(rec, size, source_size, target, copies) of each row; see mix_plan()."""
    base = docs.select(F.struct(*carry).alias("rec"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), content_hash(docs, seed).alias("dice"))
    base = written(numbered_rows(base), "mix")
    targets = with_targets(base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), most=most)
    some = F.col("size") > 0
    whole = F.when(some, F.expr("num div (cast(den as decimal(18,0)) * cast(size as decimal(18,0)))")).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).select(
        F.col("source").alias("p_source"), F.col("size").alias("source_size"), (F.col("num").cast("double") / F.col("den")).alias("target"), "whole",
        F.when(some, (F.col("num").cast("double") - F.col("whole").cast("double") * F.col("den") * F.col("size")) / (F.col("den") * F.col("size")).cast("double")).otherwise(0.0).alias("p"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / LEAF)).cast("long").alias("n_leaves"),
    )
    plan = written(plan, "plan")
    small = base.select("source", "size", "dice", "rid")
    each = met(small, plan, F.col("source").eqNullSafe(F.col("p_source")), "left").where((F.col("p") > 0) & (F.col("size") > 0))
    each = told_apart(each.select("source", "size", "dice", "rid", "p", "n_leaves"))
    leaf = F.pmod(F.xxhash64(F.lit(seed), F.col("dice")), F.col("n_leaves"))
    takes = rounded(each.select("source", leaf.alias("leaf"), "rid", "dice", F.col("size").alias("w"), "p"), seed)
    out = met(base, plan, F.col("source").eqNullSafe(F.col("p_source")), "left").join(takes.hint("merge"), "rid", "left")
    return out.select("rec", "size", "source_size", "target", (F.col("whole") + F.coalesce("take", F.lit(0))).alias("copies"))


def mix_plan(docs: DataFrame, text_col: str = "text", source_col: str = "source", seed: int = 23, most: int = 3, carry: list[str] | None = None) -> DataFrame:
    """Each row of docs once, with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes it).

    carry: the columns to pass on (all). Null and repeated ids are no matter; null sources are one source; texts
    without words, or null, have size 0 and are taken as often as their source's whole part. A hot source is cut into
    leaves like any other, by a hash of all columns, with many rows equal in every column told apart. Sources may be any
    number: their targets are found by rounds of sums, and sent to all tasks only if counted few. Reruns
    agree, however the input is laid out in files. An empty table gives an empty result. Added columns replace columns
    of the same names.
    """
    added = ["size", "source_size", "target", "copies"]
    carry = [c for c in (carry or docs.columns) if c not in added]
    return _planned(docs, carry, text_col, source_col, seed, most).select(*[F.col(f"rec.`{c}`").alias(c) for c in carry], *added)


def mixed(docs: DataFrame, text_col: str = "text", source_col: str = "source", seed: int = 23, most: int = 3) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs.

    Nulls, texts without words, hot sources, repeated rows and empty tables as in mix_plan(); no column is added, so none clashes.
    """
    plan = _planned(docs, docs.columns, text_col, source_col, seed, most).where("copies > 0")
    each = plan.select("rec", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.select(*[F.col(f"rec.`{c}`").alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    plan = mix_plan(docs, carry=["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op4_mixing": op4_mixing}
ORACLE: dict[str, str] = {}
