"""Quality checks by resampling: does a grouping survive subsampling, does it beat shuffled data."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import numbered
from ..functions.scalars import verdict
from ..functions.tables import written
from .clustering import denoised, kmeans
from .similarity import agreement, silhouette

#: Rounds, the share of vectors in each, rounds at a time.
ROUNDS, FRACTION, AT_ONCE = 12, 0.8, 4
#: Seeded fits of k-means, of which the best counts: over all vectors, and in each round.
RESTARTS, ROUND_RESTARTS = 10, 5


def subsample(vectors: DataFrame, round_no: int, fraction: float = FRACTION) -> DataFrame:
    """The share of ids that comes first in the round's pseudo-random order."""
    order = F.md5(F.concat(F.lit(f"{round_no}:"), F.col("id").cast("string")))
    ranked = numbered(vectors.withColumn("__o", order).orderBy("__o"), "__n")
    return ranked.where(F.col("__n") <= int(vectors.count() * fraction)).drop("__o", "__n")


def column_shuffled(vectors: DataFrame) -> DataFrame:
    """(id, v): each dimension permuted by itself, in a pseudo-random order of ids. All vectors have the same length.

    The values are put in two orders, each by dimension first, and meet by their place in them: no task holds a dimension."""
    each = vectors.select("id", F.posexplode("v").alias("pos", "x"))
    order = F.md5(F.concat_ws(":", F.col("pos").cast("string"), F.col("id").cast("string")))
    by_id = numbered(each.select("id", "pos").orderBy("pos", "id"), "at")
    by_dice = numbered(each.withColumn("o", order).orderBy("pos", "o", "id").select("x"), "at")
    moved = by_id.join(by_dice, "at")
    return moved.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda t: t["x"]).alias("v"))


def _pairs_by_common(counts: dict[int, int], rounds: int) -> np.ndarray:
    """From the number of members by set of rounds (as bits): the number of ordered pairs, self included, by the number of rounds in common."""
    f = np.zeros(1 << rounds)
    for mask, n in counts.items():
        f[mask] += n
    f = f.reshape([2] * rounds)
    for axis in range(rounds):  # sums over supersets; their squares count pairs whose common rounds hold a set
        f = np.stack([f.sum(axis), f.take(1, axis)], axis)
    g = f * f
    for axis in range(rounds):  # and back: pairs whose common rounds are just that set
        g = np.stack([g.take(0, axis) - g.take(1, axis), g.take(1, axis)], axis)
    bits = np.array([bin(m).count("1") for m in range(1 << rounds)])
    return np.bincount(bits, weights=np.round(g).ravel(), minlength=rounds + 1)


def meeting_share(drawn: DataFrame, rounds: int) -> DataFrame:
    """One row (stability, rounds) from given groups: of pairs that share ``base``, the mean share of the rounds with both in which they
    share ``r0``, ``r1``, ... (null: not drawn). Pairs that no round has don't count; no pairs give null. At most 16 rounds.

    No pair is listed: members are counted by group and by the set of rounds that drew them, at most k * k * rounds * 2^rounds
    counts whatever their number, and pairs follow from the counts.
    """
    if rounds > 16:
        raise ValueError("at most 16 rounds")
    mask = reduce(lambda a, b: a + b, [F.when(F.col(f"r{r}").isNotNull(), 1 << r).otherwise(0) for r in range(rounds)])
    each = drawn.select("base", mask.alias("mask"), F.posexplode(F.array(F.lit(-1), *[f"r{r}" for r in range(rounds)])).alias("round", "cluster")).where("cluster is not null")
    groups: dict[tuple, dict[int, int]] = {}
    for r in each.groupBy("base", "round", "cluster", "mask").count().collect():
        groups.setdefault((r["base"], r["round"], r["cluster"]), {})[r["mask"]] = r["count"]
    share, pairs = 0.0, 0.0
    for (_, of, _), counts in groups.items():
        n = _pairs_by_common(counts, rounds)
        for m, c in counts.items():  # nobody is a pair with itself
            n[bin(m).count("1")] -= c
        if of == 0:  # the full fit
            pairs += n[1:].sum()
        else:
            share += (n[1:] / np.arange(1, rounds + 1)).sum()
    value = round(float(share / pairs), 4) if pairs else None
    return drawn.sparkSession.createDataFrame([(value, rounds)], "stability double, rounds int")


def stability(vectors: DataFrame, k: int, rounds: int = ROUNDS, seed: int = 42, restarts: int = RESTARTS, round_restarts: int = ROUND_RESTARTS) -> DataFrame:
    """One row (stability, rounds): of pairs grouped together in the full fit, the mean share of rounds with both in which they meet again.

    Each round fits a subsample anew; its spaces and groups are written tables. AT_ONCE rounds go on together, since a round's many short jobs
    leave cores idle. Fewer than 3 * k vectors give null.
    """
    if vectors.count() < 3 * k:
        return vectors.sparkSession.createDataFrame([(None, 0)], "stability double, rounds int")
    fitted = lambda v, n, s: written(kmeans(written(denoised(v).select("id", "space"), "space"), k, n, s)[0].select("id", "cluster"), "groups")
    drawn = fitted(vectors, restarts, seed).withColumnRenamed("cluster", "base")
    with ThreadPoolExecutor(AT_ONCE) as pool:
        groups = list(pool.map(lambda r: fitted(subsample(vectors, r), round_restarts, seed + r), range(rounds)))
    for r, own in enumerate(groups):
        drawn = drawn.join(own.withColumnRenamed("cluster", f"r{r}"), "id", "left")
    return meeting_share(drawn, rounds)


def against_shuffled(vectors: DataFrame, k: int, seed: int = 42, restarts: int = RESTARTS) -> DataFrame:
    """One row: silhouette, shuffled_silhouette, beats_noise (by half)."""

    def score(v: DataFrame, name: str) -> DataFrame:
        fit = kmeans(written(denoised(v).select("id", "space"), "space"), k, restarts, seed)[0]
        return silhouette(fit.select("id", F.col("cluster").cast("int").alias("label"), F.col("space").alias("v"))).toDF(name)

    both = score(vectors, "silhouette").crossJoin(score(column_shuffled(vectors), "shuffled_silhouette"))
    return both.withColumn("beats_noise", F.col("silhouette") > 1.5 * F.col("shuffled_silhouette"))


def with_verdict(checks: DataFrame) -> DataFrame:
    """checks (lift, stability, beats_noise) with checks_passed and verdict."""
    passed = reduce(lambda a, b: a + b, [F.coalesce(c.cast("int"), F.lit(0)) for c in (F.col("lift") >= 2.0, F.col("stability") >= 0.60, F.col("beats_noise"))])
    return checks.withColumn("checks_passed", passed).withColumn("verdict", verdict(F.col("checks_passed")))


def report(vectors: DataFrame, k: int, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """One row of all quality figures; vectors carry the labels of the run."""
    parts = [agreement(vectors), stability(vectors, k, rounds, seed), against_shuffled(vectors, k, seed)]
    return with_verdict(reduce(lambda a, b: a.crossJoin(b), parts))
