"""A layout of vectors in a few dimensions that keeps neighbours near: fuzzy neighbour graph, spectral start, sampled gradient steps.

Edges are weighted by how near a neighbour is on the scale of its vector's own neighbourhood. The start are the slowest
directions of diffusion over the graph, found by a few rounds of subspace iteration that begin with the principal components. Then
points move in rounds: a point's K neighbours meet it by a join, a bounded sample of all points goes to all tasks, and each task moves
its points several steps towards their neighbours and away from the sample. Every round is a written table; what is shuffled
is K rows a point, and the driver holds the sample and small matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import dropped, written
from ..functions.vectors import unit
from . import neighbour_index
from .clustering import projected
from .similarity import knn

#: Neighbours, rounds of diffusion, rounds of movement and steps in each, points of the sample that others are pushed from.
K, DIFFUSE, ROUNDS, STEPS, SAMPLE = 15, 6, 10, 10, 2048
#: The curve of attraction for a least distance of 0.1, and the pushes a pull.
CURVE_A, CURVE_B, PUSHES = 1.577, 0.895, 5


def fuzzy_graph(vectors: DataFrame, k: int = K, index: bool = False, near: DataFrame | None = None) -> DataFrame:
    """(i, j, w): each vector's k nearest by cosine distance, weighted 1 for the nearest and falling on a scale at which weights sum to log2(k);
    then w + w' - w * w' with the weight of the way back. index: neighbours by the inverted file instead of all pairs.
    near: knn() of the unit vectors, where it is known."""
    if near is None:
        v = vectors.select("id", unit(F.col("v")).alias("v"))
        near = neighbour_index.knn_index(v, k) if index else knn(v, k)
    near = near.where(F.col("rank") <= k).select("i", "j", (1 - F.col("sim")).alias("far"))
    lists = written(near.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("far", "j"))).alias("near")), "near")  # k a vector

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, found in zip(b["i"], b["near"]):
                far = np.array([max(x["far"], 0.0) for x in found])
                over, low, high = far - far[0], 1e-9, 10.0
                for _ in range(50):
                    mid = (low * high) ** 0.5
                    low, high = (mid, high) if np.exp(-over / mid).sum() < np.log2(k) else (low, mid)
                yield pd.DataFrame({"i": i, "j": [x["j"] for x in found], "w": np.exp(-over / high)})

    one = written(lists.mapInPandas(weigh, "i long, j long, w double"), "edges")
    back = one.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("b"))
    return one.join(back, ["i", "j"], "left").select("i", "j", (F.col("w") + F.coalesce("b", F.lit(0.0)) * (1 - F.col("w"))).alias("w"))


def diffused(start: DataFrame, edges: DataFrame, dims: int, rounds: int = DIFFUSE) -> DataFrame:
    """(id, y): the slowest directions of diffusion over the graph but the constant one. start: (id, y) to begin with."""
    both = edges.select("i", "j", "w").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.max("w").alias("w"))
    both = written(both, "both")
    degree = written(both.groupBy("i").agg(F.sum("w").alias("d")).withColumnRenamed("i", "id"), "degrees")
    at = [F.col("y")[a] for a in range(dims)]
    here = written(start.join(degree, "id").select("id", "d", "y"), "start")
    for _ in range(rounds):
        # orthonormal under the degrees, and to the constant direction
        sums = here.agg(F.sum("d").alias("d"), *[F.sum(F.col("d") * a).alias(f"m{n}") for n, a in enumerate(at)], *[F.sum(F.col("d") * at[p] * at[q]).alias(f"g{p}_{q}") for p in range(dims) for q in range(dims)]).first()
        mean = np.array([sums[f"m{n}"] for n in range(dims)]) / sums["d"]
        gram = np.array([[sums[f"g{p}_{q}"] for q in range(dims)] for p in range(dims)]) / sums["d"] - np.outer(mean, mean)
        turn = np.linalg.inv(np.linalg.cholesky(gram + 1e-12 * max(np.trace(gram), 1e-300) * np.eye(dims)))
        centred = [a - float(m) for a, m in zip(at, mean)]
        y = F.array(*[sum((float(turn[p, q]) * centred[q] for q in range(dims)), F.lit(0.0)) for p in range(dims)])
        now = written(here.select("id", "d", y.alias("y")), "turned")
        flow = both.join(now.select(F.col("id").alias("j"), "y"), "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col("y")[a]).alias(f"f{a}") for a in range(dims)])
        mixed = now.join(flow.withColumnRenamed("i", "id"), "id").select("id", "d", F.array(*[(F.col("y")[a] + F.col(f"f{a}") / F.col("d")) / 2 for a in range(dims)]).alias("y"))
        here = written(mixed, "diffused")
        dropped(now)
    return here.select("id", "y")


def moved(y: np.ndarray, to: np.ndarray, w: np.ndarray, sample: np.ndarray, rate: float, steps: int, rng: np.random.Generator) -> np.ndarray:
    """Points (n, d) after some steps towards their neighbours (n, k, d) of weights (n, k), 0 for none, and away from points of a sample."""
    for s in range(steps):
        step = rate * (1 - s / (2 * steps))
        gap = y[:, None, :] - to
        far = (gap**2).sum(2)
        pull = -2 * CURVE_A * CURVE_B * np.maximum(far, 1e-12) ** (CURVE_B - 1) / (1 + CURVE_A * far**CURVE_B)
        chosen = rng.random(w.shape) < w
        force = np.clip((pull * chosen)[:, :, None] * gap, -4, 4).sum(1)
        gap = y[:, None, :] - sample[rng.integers(0, len(sample), (len(y), PUSHES))]
        far = (gap**2).sum(2)
        push = 2 * CURVE_B / ((1e-3 + far) * (1 + CURVE_A * far**CURVE_B)) * (far > 0)
        force += np.clip(push[:, :, None] * gap, -4, 4).sum(1) * chosen.sum(1)[:, None] / max(PUSHES, 1)
        y = y + step * force / np.maximum(chosen.sum(1), 1)[:, None]
    return y


def layout(vectors: DataFrame, dims: int = 3, k: int = K, seed: int = 42, rounds: int = ROUNDS, index: bool = False, near: DataFrame | None = None) -> DataFrame:
    """(id, space): vectors (id, v) in dims dimensions. near: knn() of the unit vectors, where it is known. The same seed gives the same layout, however the input is laid out.

    Fewer than dims + 3 vectors, or vectors that are all equal, are only projected. Equal vectors are near each other, not one point. Vectors
    must not be null; an empty table gives no rows.
    """
    vectors = written(vectors.select("id", "v"), "vectors")
    n = vectors.count()
    k = min(k, n - 1)
    if n < dims + 3 or vectors.select("v").distinct().limit(dims + 1).count() <= dims:
        width = F.size("v")
        return vectors.select("id", F.slice(F.concat("v", F.array_repeat(F.lit(0.0), dims)), 1, dims).alias("space")) if n < 2 else projected(vectors.where(width > 0), min(dims, n, len(vectors.first()["v"])))[0].select("id", "space")
    edges = written(fuzzy_graph(vectors, k, index, near), "graph")
    first = written(projected(vectors, dims)[0].select("id", F.col("space").alias("y")), "projected")
    y = diffused(first, edges, dims)
    spread = y.agg(*[F.max(F.abs(F.col("y")[a])).alias(f"s{a}") for a in range(dims)]).first()
    scale = [10.0 / max(spread[f"s{a}"] or 0.0, 1e-300) for a in range(dims)]
    here = written(y.select("id", F.array(*[F.col("y")[a] * scale[a] for a in range(dims)]).alias("y")), "layout")
    for r in range(rounds):
        sample = np.array([x["y"] for x in here.orderBy(F.xxhash64(F.lit(seed + r), "id"), "id").limit(SAMPLE).select("y").collect()])
        rate = 1.0 - r / rounds

        def run(batches: Iterator[pd.DataFrame], sample: np.ndarray = sample, rate: float = rate, r: int = r) -> Iterator[pd.DataFrame]:
            for b in batches:
                own = np.stack(b["y"].to_numpy())
                to, w = np.zeros((len(b), k, own.shape[1])), np.zeros((len(b), k))
                for n_, near in enumerate(b["near"]):
                    for m, x in enumerate(near):
                        to[n_, m], w[n_, m] = x["y"], x["w"]
                out = np.empty_like(own)
                for n_, i in enumerate(b["id"]):  # a generator for each point, so that batches make no difference
                    out[n_] = moved(own[n_:n_ + 1], to[n_:n_ + 1], w[n_:n_ + 1], sample, rate, STEPS, np.random.default_rng([seed, r, int(i) & (1 << 63) - 1]))[0]
                yield pd.DataFrame({"id": b["id"], "y": list(out)})

        near = edges.join(here.select(F.col("id").alias("j"), "y"), "j").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "w", "y"))).alias("near"))  # k a point
        last = here
        here = written(here.join(near.withColumnRenamed("i", "id"), "id").mapInPandas(run, "id long, y array<double>"), "layout")
        dropped(last)
    return here.select("id", F.col("y").alias("space"))


def kept_neighbours(vectors: DataFrame, placed: DataFrame, k: int = K, every: int = 1, truth: DataFrame | None = None) -> float:
    """The share of the k nearest in the layout that are among the 2 * k nearest by cosine, of all rows against all rows. every: only of ids
    divisible by it. truth: knn() of the unit vectors, where it is known."""
    if truth is None:
        v = vectors.select("id", unit(F.col("v")).alias("v"))
        truth = knn(v, 2 * k) if every == 1 else neighbour_index.exact(v.where(F.col("id") % every == 0), v, 2 * k)
    truth = truth.where(F.col("rank") <= 2 * k).select("i", "j")
    if every == 1:
        near = knn(placed.select("id", F.col("space").alias("v")), k, by_distance=True).select("i", "j")
    else:
        # the nearest by distance are the largest by dot product, with half the squared length as one more coordinate
        half = F.aggregate("space", F.lit(0.0), lambda s, x: s + x * x) / -2
        base = placed.select("id", F.concat("space", F.array(half)).alias("v"))
        asked = placed.where(F.col("id") % every == 0).select("id", F.concat("space", F.array(F.lit(1.0))).alias("v"))
        near = neighbour_index.exact(asked, base, k).select("i", "j")
    near = written(near, "nearest")
    return near.join(truth, ["i", "j"]).count() / max(near.count(), 1)
