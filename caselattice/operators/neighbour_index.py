"""Nearest neighbours by an inverted file: work and shuffle in proportion to the rows times the lists probed, where knn() takes all pairs.

Lists are the cells of coarse centroids, fitted on a sample of at most SAMPLE_ROWS rows a list. Every row is in the list of its
nearest centroid; as a query it is sent to the few lists whose centroids are nearest to it. There it meets the rows of the list
in bounded tiles and takes its best k by the exact dot product, so only what lies in lists that weren't probed can be missed. How many
lists are probed is calibrated: up to PILOTS rows are compared with all rows, and probes are as many as show the wanted share of
their true neighbours. Vectors are best of length 1, else far ones of great length are missed.

Equal vectors are one entry, with the first ids that have it, so copies don't fill a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import dropped, met, written
from .similarity import TILE_BYTES, _best, _matrix, nearest

#: Most lists (there are as many as the root of the rows), rows of the sample a list, passes of the fit, pilots, most rows of a tile's side.
MOST_LISTS, SAMPLE_ROWS, PASSES, PILOTS, TILE_ROWS = 16_384, 64, 8, 512, 32_768


def entries(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct vectors (rep, v), the smallest id of each standing for it; all rows (id, rep); and of each vector the first k + 1 ids (rep, j)."""
    keyed = vectors.select("id", "v", F.xxhash64(F.lit(1), "v").alias("h"), F.xxhash64(F.lit(2), "v").alias("g"))
    reps = written(keyed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.min_by("v", "id").alias("v")), "entries")
    of = written(met(keyed.select("id", "h", "g"), reps.select("h", "g", "rep"), ["h", "g"]).select("id", "rep"), "members")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    firsts = of.withColumn("place", place).where(F.col("place") <= k + 1).select("rep", F.col("id").alias("j"))
    return reps.select("rep", "v"), of, written(firsts, "firsts")


def fitted(reps: DataFrame, n: int, lists: int, seed: int) -> np.ndarray:
    """(lists, d) centroids of length 1. At most SAMPLE_ROWS * lists rows, chosen by a seeded hash, in at most 8 tasks; a centroid that loses its rows stays."""
    dice = F.xxhash64(F.lit(seed), "rep")
    share = min(1.0, SAMPLE_ROWS * lists / max(n, 1))
    sample = reps.where(F.shiftrightunsigned(dice, 11) / F.lit(float(1 << 53)) <= share).select("rep", "v")
    first = sample.orderBy(dice, "rep").limit(lists).select("v").toArrow().combine_chunks()
    sample = written(sample.select("v").coalesce(8), "sample")
    centres = _matrix(first["v"].combine_chunks()) if first.num_rows else np.zeros((0, 0))
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1)), 1e-300)[:, None]
    centres = unit(centres)
    for _ in range(PASSES if len(centres) > 1 else 0):
        held = centres

        def run(batches: Iterator[pa.RecordBatch], held: np.ndarray = held) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(held.shape), np.zeros(len(held), np.int64)
            for whole in batches:
                for s in range(0, whole.num_rows, 1024):
                    x = _matrix(pa.concat_arrays([whole.slice(s, 1024)["v"]]))
                    own = (x @ held.T).argmax(1)
                    np.add.at(sums, own, x)
                    counts += np.bincount(own, minlength=len(held))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(sums[used]), pa.list_(pa.float64()))], names=["c", "s"])

        parts = sample.mapInArrow(run, "c long, s array<double>").toArrow()
        sums = np.zeros(centres.shape)
        if parts.num_rows:
            np.add.at(sums, parts["c"].to_numpy(), _matrix(parts["s"].combine_chunks()))
        centres = unit(np.where((sums != 0).any(1)[:, None], sums, centres))
    dropped(sample)
    return centres


def ranked(rows: DataFrame, centres: np.ndarray, most: int) -> DataFrame:
    """rows (with v) and ``lists``: the ``most`` lists nearest to each, best first."""
    most, cols = min(most, len(centres)), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                sims = _matrix(pa.concat_arrays([b["v"]])) @ centres.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :most] if most > 64 else _best(sims, most)
                yield pa.RecordBatch.from_arrays([*[b[c] for c in cols], pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=[*cols, "lists"])

    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("array<int>").alias("lists")).schema)


def exact(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(i, j, sim): the k best of vectors (id, v) for each of queries (id, v), a stated set, by comparing them with all rows, ``block`` queries at a time.

    Each block is sent to all tasks, which keep k rows a query; the best of all tasks follow. Ties by id.
    """
    stated = written(queries.select("id", "v"), "queries")
    blocks, out = max(1, -(-stated.count() // block)), None
    for q in range(blocks):
        own = stated.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == q).toArrow().combine_chunks()
        ids, m = (own["id"].to_numpy(), _matrix(own["v"].combine_chunks())) if own.num_rows else (np.zeros(0, np.int64), np.zeros((0, 0)))

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, m: np.ndarray = m) -> Iterator[pa.RecordBatch]:
            kept = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for whole in batches:
                for s in range(0, whole.num_rows if len(ids) else 0, 8192):
                    b = whole.slice(s, 8192)
                    kept = nearest(ids, m, b["id"].to_numpy(), _matrix(pa.concat_arrays([b["v"]])), k, kept)
            best_sim, best_id = kept
            real = np.isfinite(best_sim)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[real.ravel()]), pa.array(best_id[real]), pa.array(best_sim[real])], names=["i", "j", "sim"])

        part = vectors.select("id", "v").mapInArrow(run, "i long, j long, sim double")
        out = part if out is None else out.unionByName(part)
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j"))
    return out.withColumn("rank", place).where(F.col("rank") <= k)


def calibrated(reps: DataFrame, centres: np.ndarray, k: int, wanted: float, seed: int) -> int:
    """Lists to probe so that pilots find the wanted share of their true neighbours."""
    pilots = written(reps.orderBy(F.xxhash64(F.lit(seed + 1), "rep")).limit(PILOTS).select(F.col("rep").alias("id"), "v"), "pilots")
    near = written(exact(pilots, reps.select(F.col("rep").alias("id"), "v"), k).select("i", "j"), "near")
    them = reps.join(F.broadcast(near.select(F.col("j").alias("rep")).distinct()), "rep", "left_semi")
    own = ranked(them, centres, 1).select(F.col("rep").alias("j"), F.col("lists")[0].alias("list"))
    order = ranked(pilots, centres, len(centres)).select(F.col("id").alias("i"), "lists")
    places = near.join(own, "j").join(order, "i").select(F.array_position("lists", F.col("list")).alias("p")).toPandas()["p"]
    return int(np.quantile(places, wanted, method="higher")) if len(places) else 1


def shelves(centres: np.ndarray, held: dict[int, int], side: int) -> np.ndarray:
    """Each list's shelf: lists in the order of their centroids' first principal component, about ``side`` rows a shelf. A query travels once a shelf, not once a list."""
    centred = centres - centres.mean(0)
    order = np.argsort(centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1], kind="stable")
    out = np.zeros(len(centres), np.int64)
    sizes = np.array([held.get(int(c), 0) for c in order], np.int64)
    out[order] = (np.cumsum(sizes) - sizes) // side
    return out


def knn_index(vectors: DataFrame, k: int = 3, wanted: float = 0.93, probes: int | None = None, lists: int | None = None, seed: int = 42) -> DataFrame:
    """(i, j, sim, rank): k near others of every vector (id, v), ties by id, by an inverted file over all rows. Rows of a null id or vector are left out.

    wanted: the share of true neighbours that pilots must find, from which the lists probed follow (or give probes). Results are
    exact where all lists are probed. Lists share shelves of at most TILE_ROWS rows or TILE_BYTES, about; a shelf of more, or probed by many, is cut into tiles of that side, dealt to
    different tasks. A single vector has no neighbours; an empty table gives no rows.
    """
    vectors = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v")
    reps, of, firsts = entries(vectors, k)
    n = reps.count()
    lists = min(lists or int(n**0.5), n, MOST_LISTS) or 1
    centres = fitted(reps, n, lists, seed)
    if not len(centres):
        return vectors.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("sim"), F.lit(1).alias("rank")).where("false")
    probes = min(len(centres), probes or calibrated(reps, centres, k, wanted, seed))
    placed = written(ranked(reps, centres, probes), "placed")
    base = placed.select("rep", "v", F.col("lists")[0].alias("list"))
    held = {r["list"]: r["held"] for r in base.groupBy("list").agg(F.count("*").alias("held")).collect()}  # at most MOST_LISTS rows of two numbers
    tiles = 2 * vectors.sparkSession.sparkContext.defaultParallelism  # at least, where all lists are probed
    side = max(1, min(TILE_ROWS, TILE_BYTES // (8 * centres.shape[1]), -(-n // int(tiles**0.5))))
    shelf, most = shelves(centres, held, side), F.lit(side)
    on = F.array(*[F.lit(int(x)) for x in shelf]) if len(shelf) <= 64 else F.from_json(F.lit(str(shelf.tolist())), "array<int>")
    base = base.withColumn("shelf", F.get(on, F.col("list")))
    asked = placed.select(F.col("rep").alias("i"), F.col("v").alias("w"), F.explode(F.array_distinct(F.transform("lists", lambda x: F.get(on, x)))).alias("shelf"), "lists")
    asked = asked.withColumn("lists", F.filter("lists", lambda x: F.get(on, x) == F.col("shelf")))
    sizes, wants = base.groupBy("shelf").agg(F.count("*").alias("held")), asked.groupBy("shelf").agg(F.count("*").alias("wants"))
    cuts = sizes.join(wants, "shelf", "full").select("shelf", F.ceil(F.coalesce("held", F.lit(1)) / most).alias("a"), F.ceil(F.coalesce("wants", F.lit(1)) / most).alias("b"))
    cuts = F.broadcast(written(cuts, "cuts"))  # at most MOST_LISTS rows of three numbers
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    base = base.join(cuts, "shelf").withColumn("x", F.pmod(F.xxhash64("rep"), F.col("a"))).select("shelf", "x", every("b").alias("y"), "list", "rep", "v")
    asked = asked.join(cuts, "shelf").withColumn("y", F.pmod(F.xxhash64("i"), F.col("b"))).select("shelf", every("a").alias("x"), "y", "i", "w", "lists")

    def tile(own: pd.DataFrame, wants: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(wants):
            return pd.DataFrame({"i": [], "rep": [], "sim": []})
        m, ids, lists, w, i = np.stack(own["v"].to_numpy()), own["rep"].to_numpy(), own["list"].to_numpy(), np.stack(wants["w"].to_numpy()), wants["i"].to_numpy()
        row, asks = np.repeat(np.arange(len(wants)), wants["lists"].str.len()), np.concatenate(wants["lists"].to_numpy())
        sim, rep = np.full((len(i), k), -np.inf), np.full((len(i), k), np.iinfo(np.int64).max)
        for c in np.unique(lists):
            r, o = row[asks == c], lists == c
            if len(r):
                sim[r], rep[r] = nearest(i[r], w[r], ids[o], m[o], k, (sim[r], rep[r]))
        real = np.isfinite(sim)
        return pd.DataFrame({"i": np.repeat(i, k)[real.ravel()], "rep": rep[real], "sim": sim[real]})

    keys = ["shelf", "x", "y"]
    found = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(tile, "i long, rep long, sim double")
    best = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "rep"))
    found = written(found.withColumn("place", best).where(F.col("place") <= k).drop("place"), "found")
    # entries back to rows: each near entry stands for its first ids, and a row's own entry for the others that have its vector
    length = F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 9)
    same = reps.select(F.col("rep").alias("i"), "rep", length.alias("sim"))
    near = found.unionByName(same).join(firsts, "rep").select(F.col("i").alias("rep"), "j", "sim")
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("sim"), "j"))
    near = written(near.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("place", "j", "sim"))).alias("near")), "near")
    rows = met(of, near, "rep").select(F.col("id").alias("i"), F.filter("near", lambda x: x["j"] != F.col("id")).alias("near"))
    out = rows.select("i", F.posexplode(F.slice("near", 1, k)).alias("at", "x"))
    return out.select("i", F.col("x.j").alias("j"), F.col("x.sim").alias("sim"), (F.col("at") + 1).alias("rank"))


def recall(near: DataFrame, vectors: DataFrame, k: int = 3, every: int = 50) -> DataFrame:
    """One row: queries (ids divisible by ``every``) and the share of their true k neighbours that near has. A neighbour as similar as the k-th counts."""
    queries = vectors.where(F.col("id") % every == 0)
    truth = exact(queries, vectors, k)
    least = truth.groupBy("i").agg(F.count("*").alias("wanted"), F.min("sim").alias("least"))
    got = near.join(least, "i").groupBy("i", "wanted").agg(F.count_if(F.col("sim") >= F.col("least") - 1e-9).alias("got"))
    met_ = least.select("i", "wanted").join(got.select("i", "got"), "i", "left")
    return met_.agg(F.count("*").alias("queries"), (F.sum(F.coalesce("got", F.lit(0))) / F.sum("wanted")).alias("recall"))
