"""Neighbours and centroids of vectors: (id long, label int, v array<double>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import dropped, written
from ..functions.vectors import dot, unit

MOST_CENTROIDS, MOST_BANK_BYTES = 10_000, 256 << 20
#: Bytes of one side of a tile of pairs, and rows of the two sides that a task multiplies at once.
TILE_BYTES, BLOCK = 16 << 20, (512, 4096)
#: Of knn(): bytes of a packed block of vectors, blocks of a file, and what holds while pairs of files meet: a file is a partition, and Python gets a few pairs of blocks at once.
PACK_BYTES, FILE_BLOCKS = 4 << 20, 16
MEETING = {"spark.sql.files.maxPartitionBytes": str(PACK_BYTES * (FILE_BLOCKS + 4)), "spark.sql.execution.arrow.maxRecordsPerBatch": "4"}


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k largest values, best first, the first of equal ones first."""
    if sims.shape[1] <= k + 1:  # few columns, one of which may be ruled out: none may come twice
        return np.argsort(-sims, axis=1, kind="stable")[:, :k]
    left, out = sims.copy(), np.empty((len(sims), min(k, sims.shape[1])), np.int64)
    for r in range(out.shape[1]):
        out[:, r] = left.argmax(1)
        left[np.arange(len(left)), out[:, r]] = -np.inf
    return out


def nearest(ids: np.ndarray, m: np.ndarray, others: np.ndarray, w: np.ndarray, k: int, kept: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, ids), each (rows of m, k): the k rows of w of largest dot product (to 9 places) but those of a row's own id, ties by id; -inf where there are fewer.

    kept: what earlier rows gave, which these are added to. Pairs are multiplied in blocks that stay in a core's cache, in single precision; those
    that its error leaves in question are multiplied again in double, so the result is that of doubles. Where that is
    much of a block, as among copies, the whole block is.
    """
    order = np.argsort(others, kind="stable")
    others, w = others[order], np.ascontiguousarray(w[order])
    best_sim, best_id = kept if kept is not None else (np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max))
    length, far = np.sqrt((m * m).sum(1)), np.sqrt((w * w).sum(1))
    # values that single precision can't hold are all in question
    fits = len(ids) and len(others) and length.max() < 1e15 and far.max() < 1e15
    thin, thin_w = (m.astype(np.float32), w.astype(np.float32)) if fits else (m, w)
    for s in range(0, len(ids), BLOCK[0]):
        rows = slice(s, s + BLOCK[0])
        for t in range(0, len(others), BLOCK[1]):
            cols = slice(t, t + BLOCK[1])
            here, block = others[cols], w[cols]
            sims = thin[rows] @ thin_w[cols].T
            first, last = np.searchsorted(here, ids[rows]), np.searchsorted(here, ids[rows], "right")
            own = [(r, slice(first[r], last[r])) for r in np.flatnonzero(first < last)]
            for r, c in own:
                sims[r, c] = -np.inf
            slack = 2.0 ** -23 * (m.shape[1] + 8) * length[rows] * far[cols].max() + 1e-8
            least = best_sim[rows, -1]
            if np.isneginf(least).any() and len(here) > k:
                least = np.maximum(least, np.partition(sims, len(here) - k, 1)[:, len(here) - k] - slack)
            open_ = sims >= (least - slack).astype(sims.dtype)[:, None]
            if fits and np.count_nonzero(open_) <= open_.size >> 4:
                r, c = np.divmod(np.flatnonzero(open_), len(here))
                sim = np.round(np.concatenate([np.einsum("ij,ij->i", m[rows][r[q:q + 16384]], block[c[q:q + 16384]]) for q in range(0, max(len(r), 1), 16384)]), 9)
            else:
                sims = np.round(m[rows] @ block.T, 9)
                for r, c in own:
                    sims[r, c] = -np.inf
                at = _best(sims, k)
                sim, r, c = np.take_along_axis(sims, at, 1).ravel(), np.repeat(np.arange(len(at)), at.shape[1]), at.ravel()
            new = np.isfinite(sim) & ((sim > best_sim[rows, -1][r]) | ((sim == best_sim[rows, -1][r]) & (here[c] < best_id[rows, -1][r])))
            if not new.any():
                continue
            r, sim, found = r[new], sim[new], here[c[new]]
            met = np.unique(r)
            r, sim, found = np.concatenate([r, np.repeat(met, k)]), np.concatenate([sim, best_sim[rows][met].ravel()]), np.concatenate([found, best_id[rows][met].ravel()])
            order = np.lexsort((found, -sim, r))
            starts = np.searchsorted(r[order], met)
            top = order[starts[:, None] + np.arange(k)[None, :]]
            best_sim[s + met], best_id[s + met] = sim[top], found[top]
    return best_sim, best_id


def _groups(vectors: DataFrame, block_rows: int | None) -> int:
    """Into how many groups rows are dealt, so that a tile's side has about block_rows, or TILE_BYTES, and all cores have a tile."""
    n, sc = vectors.count(), vectors.sparkSession.sparkContext
    if block_rows is None:
        first = vectors.select(F.size("v").alias("n")).first()
        block_rows = max(1, TILE_BYTES // (8 * max(1, first["n"] if first else 1)))
        return min(max(1, -(-n // block_rows), int(sc.defaultParallelism**0.5)), max(1, n))
    return max(1, -(-n // block_rows))


def _tiles(vectors: DataFrame, groups: int, cols: list[str]) -> DataFrame:
    """Every pair of groups as one row: the arrays of cols of the first group, as ``<col>_a``, and of the second. Each row of vectors is
    sent to 2 * groups tiles; tiles are tasks' units, so the work is spread over groups * groups of them."""
    deal = vectors.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    lists = lambda e: [F.flatten(F.collect_list("v")).alias(f"v{e}") if c == "v" else F.collect_list(c).alias(f"{c}{e}") for c in cols]
    packed = lambda e: deal.groupBy("g").agg(*lists(e))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = packed("_a").select(F.col("g").alias("x"), every.alias("y"), *[f"{c}_a" for c in cols])
    right = packed("").select(every.alias("x"), F.col("g").alias("y"), *cols)
    return left.join(right, ["x", "y"])


def _packed(vectors: DataFrame, block_rows: int | None) -> DataFrame:
    """(ids, vs, n): the vectors as blocks of numbers of at most block_rows, or PACK_BYTES. A file has FILE_BLOCKS of them; small tables have as many files as give all cores pairs of files."""
    n, sc = vectors.count(), vectors.sparkSession.sparkContext
    if block_rows is None:
        first = vectors.select(F.size("v").alias("n")).first()
        block_rows = max(1, PACK_BYTES // (8 * max(1, first["n"] if first else 1)))
    files = max(1, -(-n // (block_rows * FILE_BLOCKS)), min(n, int((2 * sc.defaultParallelism) ** 0.5)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def block(rows: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            own, rest = t.slice(0, rows), t.slice(rows)
            held[:] = rest.to_batches()
            v = np.concatenate([_matrix(c) for c in own["v"].chunks])
            return pa.RecordBatch.from_arrays([pa.array([own["id"].to_numpy().tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([own.num_rows])], names=["ids", "vs", "n"])

        for b in batches:
            held, rows = [*held, b], rows + b.num_rows
            while rows >= block_rows:
                yield block(block_rows)
                rows -= block_rows
        if rows:
            yield block(rows)

    ready = vectors.select(F.col("id").cast("long").alias("id"), "v").repartition(files, "id")
    return written(ready.mapInArrow(pack, "ids binary, vs binary, n long"), "packed", compression="uncompressed")


def knn(vectors: DataFrame, k: int = 3, block_rows: int | None = None, by_distance: bool = False) -> DataFrame:
    """(i, j, sim, rank): each vector's k most similar others by exact dot product, ties by id. by_distance: the nearest by Euclidean distance; sim is then
    the dot product less half the other's squared length.

    Vectors are shuffled once, into files of blocks; every pair of files meets in a task, which holds one of them and a few pairs of its
    blocks, whatever the table's size, and keeps k rows of each vector of the other. Nothing but those rows travels from there: k a
    vector and file. A window takes the best k of all. The work is that of all pairs (n * n). Vectors of null or other length than the first
    in their block are an error of the caller. A single vector has no neighbours.
    """
    packed = _packed(vectors, block_rows)
    pairs = packed.select(*[F.col(c).alias(f"{c}_a") for c in packed.columns]).hint("shuffle_replicate_nl").crossJoin(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x, n, kind: np.frombuffer(x.as_buffer(), kind).reshape(n, -1)
        a, m, kept = None, None, None

        def best() -> pa.RecordBatch:
            real = np.isfinite(kept[0])
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(a, k)[real.ravel()]), pa.array(kept[1][real]), pa.array(kept[0][real])], names=["i", "j", "sim"])

        for b in batches:
            for r in range(b.num_rows):
                n, n_a = b["n"][r].as_py(), b["n_a"][r].as_py()
                ids = read(b["ids_a"][r], n_a, np.int64)[:, 0]
                if a is None or not np.array_equal(a, ids):  # blocks of the other file come one after another for each block
                    if a is not None:
                        yield best()
                    a, m, kept = ids.copy(), read(b["vs_a"][r], n_a, np.float64).copy(), None
                    m = np.hstack([m, np.ones((n_a, 1))]) if by_distance else m
                c, w = read(b["ids"][r], n, np.int64)[:, 0], read(b["vs"][r], n, np.float64)
                w = np.hstack([w, (w * w).sum(1)[:, None] / -2]) if by_distance else w
                kept = nearest(a, m, c, w, k, kept)
        if a is not None:
            yield best()

    near = written(pairs.select("ids_a", "vs_a", "n_a", "ids", "vs", "n").mapInArrow(run, "i long, j long, sim double"), "met", settings=MEETING)
    dropped(packed)
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, n, v): the mean vector of each label. Summed by label and place before the shuffle."""
    each = vectors.select("label", F.posexplode("v").alias("pos", "x"))
    means = each.groupBy("label", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy("label").agg(
        F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v")
    )


def small_array(rows: DataFrame, most: int = MOST_CENTROIDS) -> Column:
    """The rows as a constant array of structs, after a check that they are at most ``most``."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: too many for every task to hold")
    kind = rows.schema.simpleString()
    if not found:
        return F.array().cast(f"array<{kind}>")
    one = rows.sparkSession.createDataFrame(found, rows.schema).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("j")).first()["j"]
    return F.from_json(F.lit(one), f"array<{kind}>")


def _bank(bank: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The c and unit vectors of bank (c, v) in order of c, after a check of their number and bytes."""
    found = bank.select("c", "v").orderBy("c").limit(MOST_CENTROIDS + 1).toArrow().combine_chunks()
    if found.num_rows > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} rows: too many for every task to hold")
    if found.nbytes > MOST_BANK_BYTES:
        raise ValueError(f"{found.nbytes} bytes: too many for every task to hold")
    one = lambda name: pa.concat_arrays(found[name].chunks) if found[name].num_chunks else pa.array([], found.schema.field(name).type)
    return one("c"), _matrix(one("v"))


def centroid_sims(vectors: DataFrame, bank: DataFrame, most: int | None = None, own: str | None = None) -> DataFrame:
    """vectors with ``sims``: (sim, c) of the ``most`` best rows (default: all) of bank (c, v), best first, ties by c. bank holds unit vectors.

    A batch of vectors is made unit and multiplied with the whole bank at once. own: a column of c; then also ``own_sim``, the
    similarity to that row, and ``rival``, the best (sim, c) of the others. An empty bank gives empty sims. A zero vector stays.
    """
    cs, m = _bank(bank)
    kind = next(t for c, t in bank.dtypes if c == "c")
    most = len(cs) if most is None else min(most, len(cs))
    place = {c: i for i, c in enumerate(cs.to_pylist())} if own else {}
    cols = vectors.columns
    one = f"struct<sim:double,c:{kind}>"
    added = [F.lit(None).cast(f"array<{one}>").alias("sims")] + ([F.lit(None).cast("double").alias("own_sim"), F.lit(None).cast(one).alias("rival")] if own else [])

    def pairs(sims: np.ndarray, rows: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(sims[rows, at]), cs.take(pa.array(at, pa.int64()))], names=["sim", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                n = b.num_rows
                x = _matrix(pa.concat_arrays([b["v"]]))
                length = np.sqrt((x * x).sum(1))
                sims = np.round((x / np.where(length == 0, 1, length)[:, None]) @ m.T, 9) if len(cs) else np.zeros((n, 0))
                order = _best(sims, most) if most <= 8 else np.argsort(-sims, axis=1, kind="stable")[:, :most]
                rows = np.repeat(np.arange(n), order.shape[1])
                out = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * order.shape[1], pa.int32()), pairs(sims, rows, order.ravel()))]
                if own:
                    at = np.array([place.get(c, -1) for c in b[own].to_pylist()])
                    known, rest = at >= 0, sims.copy()
                    rest[np.flatnonzero(known), at[known]] = -np.inf
                    mine = np.where(known, sims[np.arange(n), np.maximum(at, 0)], np.nan) if len(cs) else np.full(n, np.nan)
                    best = rest.argmax(1) if len(cs) else np.zeros(n, np.int64)
                    some = np.isfinite(rest[np.arange(n), best]) if len(cs) else np.zeros(n, bool)
                    rival = pairs(sims, np.flatnonzero(some), best[some])
                    index = np.cumsum(some) - 1
                    out += [pa.array(mine, mask=~known), rival.take(pa.array(index, pa.int64(), mask=~some))]
                names = [*cols, "sims", *(["own_sim", "rival"] if own else [])]
                yield pa.RecordBatch.from_arrays([*[b[c] for c in cols], *out], names=names)

    return vectors.mapInArrow(run, vectors.select(*cols, *added).schema)


def label_bank(vectors: DataFrame) -> DataFrame:
    """(c, v): unit centroids of unit vectors, by label."""
    return centroids(vectors.withColumn("v", unit(F.col("v")))).select(F.col("label").alias("c"), unit(F.col("v")).alias("v"))


def neighbours_agreeing(vectors: DataFrame, k: int = 3, near: DataFrame | None = None) -> DataFrame:
    """(id, agree): how many of a vector's k nearest share its label. near: knn() of the unit vectors, where it is known."""
    near = knn(vectors.select("id", unit(F.col("v")).alias("v")), k) if near is None else near.where(F.col("rank") <= k)
    near = near.select(F.col("i").alias("id"), "j")
    of = vectors.select("id", "label")
    met = near.join(of, "id").join(of.toDF("j", "label_j"), "j")
    return met.groupBy("id").agg(F.sum((F.col("label") == F.col("label_j")).cast("int")).cast("int").alias("agree"))


def justification(vectors: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Why each vector is in its group: similarity to its own centre and to the next best group, margin, neighbours that agree. near: knn() of the
    unit vectors, where it is known."""
    sims = centroid_sims(vectors, label_bank(vectors), 0, "label")
    out = sims.select("id", "label", F.col("own_sim").alias("own"), F.coalesce("rival.sim", F.lit(-1.0)).alias("rival"), F.col("rival.c").alias("next_group"))
    agree = neighbours_agreeing(vectors, near=near)
    out = out.join(agree, "id", "left").withColumn("agree", F.coalesce("agree", F.lit(0)))
    return out.select(
        "id", "label", F.round("own", 4).alias("to_own"), F.round("rival", 4).alias("to_next"), "next_group",
        F.round(F.col("own") - F.col("rival"), 4).alias("margin"), F.col("agree").alias("neighbours_agreeing"), (F.col("own") - F.col("rival") < 0.02).alias("borderline"),
    )


def agreement(vectors: DataFrame) -> DataFrame:
    """One row: share of vectors whose nearest other has their label, the share by chance, and their ratio."""
    hit = neighbours_agreeing(vectors, 1).agg(F.avg("agree").alias("a"))
    return hit.crossJoin(chance(vectors)).select(
        F.round("a", 4).alias("agreement"), F.round("chance", 4).alias("chance"), F.when(F.col("chance") > 0, F.round(F.col("a") / F.col("chance"), 2)).alias("lift")
    )


def chance(vectors: DataFrame) -> DataFrame:
    """One row: the sum of the labels' squared shares."""
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("chance"))


def cohesion(vectors: DataFrame) -> DataFrame:
    """(label, n, cohesion): mean similarity of two different members, from the norm of their sum; 1 for a single member."""
    each = vectors.select("label", F.posexplode("v").alias("pos", "x"))
    sums = each.groupBy("label", "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    by = sums.groupBy("label").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"))
    mean = (F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1))
    return by.select("label", "n", F.when(F.col("n") > 1, F.round(mean, 4)).otherwise(1.0).alias("cohesion"))


def nearest_cluster(vectors: DataFrame) -> DataFrame:
    """(label, nearest, similarity): the label whose unit centroid is most similar to each label's."""
    bank = centroids(vectors).select(F.col("label").alias("c"), unit(F.col("v")).alias("v"))
    sims = centroid_sims(bank.withColumnRenamed("c", "label"), bank, 0, "label")
    return sims.select("label", F.col("rival.c").alias("nearest_cluster"), F.round("rival.sim", 4).alias("nearest_similarity"))


def exemplars(vectors: DataFrame) -> DataFrame:
    """(label, id): each label's member nearest to its unit centroid, ties by id."""
    scored = to_own_centre(vectors)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("sim"), "id"))
    return scored.withColumn("rank", rank).where("rank = 1").select("label", "id", F.round("sim", 4).alias("sim"))


def to_own_centre(vectors: DataFrame) -> DataFrame:
    """(id, label, sim): dot product with the label's unit centroid."""
    bank = small_array(centroids(vectors).select("label", unit(F.col("v")).alias("v")))
    own = F.filter(bank, lambda b: b["label"] == F.col("label"))[0]["v"]
    return vectors.select("id", "label", F.round(dot(F.col("v"), own), 9).alias("sim"))


def representatives(vectors: DataFrame, limit: int = 6) -> DataFrame:
    """(label, id, rank): the members nearest to the centre; in small groups the first by id."""
    scored = to_own_centre(vectors).join(vectors.groupBy("label").agg(F.count("*").alias("n")), "label")
    order = F.when(F.col("n") > limit, -F.col("sim"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order, "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("label", "id", "rank")


def silhouette(vectors: DataFrame, block_rows: int | None = None) -> DataFrame:
    """One row: the mean silhouette by Euclidean distance; 0 for a single label, and for singletons.

    Distances are taken in tiles, pairs of groups of rows; only sums by (vector, label) leave a tile.
    """
    tiles = _tiles(vectors.select("id", "label", "v"), _groups(vectors, block_rows), ["id", "label", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c, r=r: b[c][r].values.to_numpy()
                a, la, lb, other = get("id_a"), get("label_a"), get("label"), get("id")
                x, y = get("v_a").reshape(len(a), -1), get("v").reshape(len(lb), -1)
                order = np.argsort(lb, kind="stable")
                y, other = y[order], other[order]
                kinds, at, counts = np.unique(lb[order], return_index=True, return_counts=True)
                by_id = np.argsort(other, kind="stable")
                first, last = np.searchsorted(other[by_id], a), np.searchsorted(other[by_id], a, "right")
                sums, xx, yy = np.zeros((len(a), len(kinds))), (x * x).sum(1), (y * y).sum(1)
                for s in range(0, len(a), BLOCK[0]):
                    rows = slice(s, s + BLOCK[0])
                    for t in range(0, len(y), BLOCK[1]):
                        far = x[rows] @ y[t:t + BLOCK[1]].T
                        far *= -2
                        far += xx[rows, None]
                        far += yy[None, t:t + BLOCK[1]]
                        np.sqrt(np.maximum(far, 0, out=far), out=far)
                        for q in s + np.flatnonzero(first[rows] < last[rows]):
                            own = by_id[first[q]:last[q]] - t
                            far[q - s, own[(own >= 0) & (own < far.shape[1])]] = 0
                        some = np.flatnonzero((at < t + far.shape[1]) & (at + counts > t))
                        sums[rows, some] += np.add.reduceat(far, np.maximum(at[some] - t, 0), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(a, len(kinds))), pa.array(np.repeat(la, len(kinds)).astype(np.int32)), pa.array(np.tile(kinds, len(a)).astype(np.int32)), pa.array(sums.ravel()), pa.array(np.tile(counts, len(a)))],
                    names=["id", "label", "other", "far", "n"],
                )

    parts = tiles.select("id_a", "label_a", "v_a", "id", "label", "v").mapInArrow(run, "id long, label int, other int, far double, n long")
    sums = parts.groupBy("id", "label", "other").agg(F.sum("far").alias("far"), F.sum("n").alias("n"))
    own = F.col("label") == F.col("other")
    per = sums.groupBy("id").agg(
        F.max(F.when(own, F.when(F.col("n") > 1, F.col("far") / (F.col("n") - 1)))).alias("a"), F.min(F.when(~own, F.col("far") / F.col("n"))).alias("b")
    )
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.round(F.avg(score), 4).alias("silhouette"))
