"""N-gram Jaccard join by vertical partitioning.

The global order of all n-grams (by hash) is cut into fragments. A document's set falls into one segment a fragment.

Candidates. Two sets of similarity t or more differ in at most D elements, D bounded by their sizes, and every
differing element spoils one fragment. With D + 1 + SLACK fragments (fixed for a class of sizes) at least 1 + SLACK
segments are equal, so equal non-empty segments give all candidates. Sets with more than SLACK empty segments
could miss that way; they also meet by the first elements of their sets, enough of them that similar sets share one.

Verification. Sets are stored cut at PARTS - 1 places of the global order, a row a fragment, and a pair meets its two sets one
fragment at a time: each task has one fragment of either set and counts the overlap there, and an aggregate by pair sums
the partial overlaps. No task ever holds both whole sets.

Groups. Copies are one set from the start. Sets that share a segment are not paired with each other: each is paired with
the group's first set, and linked sets are contracted to components. What then still lies in several components meets
within the shared segment, block by block; an exact bound (bits in which two parity sketches differ never outnumber the
elements in which the sets differ) leaves the pairs that may link. The first such round takes each set's best partner,
the second all that is left between components, so no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content_hash, documents, dropped, met, one_use, written
from .quality_rules import pieces, split_words

SLACK, STEP, PARTS, BLOCK = 1, 1.5, 4, 2048
#: Bytes of text that are hashed at a time, and rows of a batch: both bound what a worker and its executor hold for it.
PIECE, BATCHES = 1 << 20, {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that looks random."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each (non-empty) word: a multilinear form of its bytes, mixed with its length."""
    if not len(words):
        return np.zeros(0, U)
    words = pa.concat_arrays([words]).cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    start, size = ends[:-1] - ends[0], np.diff(ends)
    place = np.arange(len(data), dtype=np.int32) - np.repeat(start.astype(np.int32), size)
    of_byte, of_place = mixed_bits(np.arange(256, dtype=U) + GOLD), mixed_bits(np.arange(size.max(), dtype=U) ^ GOLD)
    return mixed_bits(np.add.reduceat(of_byte[data] * of_place[place], start) + size.astype(U))


def gram_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of lower-cased words of all texts, text by text, each sorted, as 64-bit hashes; and each text's number of them.
    A text of fewer words is one n-gram; one without words has none."""
    words, doc = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    h, doc = word_hashes(words), doc.astype(np.int64)
    count = np.bincount(doc, minlength=len(texts))
    gram = mixed_bits(h + U(width))
    for k in range(1, width):
        gram = mixed_bits(gram[:-1] * U(3) + h[k:]) if len(gram) > 1 else gram[:0]
    whole = doc[:len(gram)] == doc[width - 1:width - 1 + len(gram)]
    gram, own = gram[whole], doc[:len(whole)][whole]
    start = np.cumsum(count) - count
    for c in range(1, width):
        short = np.flatnonzero(count == c)
        if len(short):
            g = mixed_bits(h[start[short]] + U(c))
            for k in range(1, c):
                g = mixed_bits(g * U(3) + h[start[short] + k])
            at = np.searchsorted(own, short)
            gram, own = np.insert(gram, at, mixed_bits(g + GOLD)), np.insert(own, at, short)
    n = np.bincount(own, minlength=len(texts))
    stop = np.cumsum(n).tolist()
    for a, b in zip([0, *stop], stop):
        gram[a:b].sort()
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])
    return gram[new], np.bincount(own[new], minlength=len(texts))


def set_ids(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each set's 64-bit identity (signed): equal sets, equal identity. Empty sets: 0."""
    out, some = np.zeros(len(n), U), n > 0
    if some.any():
        sums = np.add.reduceat(mixed_bits(grams ^ GOLD), (np.cumsum(n) - n)[some])
        out[some] = mixed_bits(mixed_bits(sums) + n[some].astype(U))
    return out.view(np.int64)


def salt(k: int) -> np.uint64:
    return U(k * int(GOLD) % (1 << 64))


_CLASSES: dict[int, tuple] = {}


def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each class of set sizes: its upper end, fragments, allowed empty segments, and two salts."""
    if percent in _CLASSES:
        return _CLASSES[percent]
    ends, step = [1], max(STEP, 100 / percent)
    while ends[-1] < 1 << 32:
        ends.append(max(ends[-1] + 1, int(ends[-1] * step)))
    differ = [2 * e * (100 - percent) // (100 + percent) for e in ends]
    slack = [SLACK + d // 24 for d in differ]
    fragments = [d + 1 + s for d, s in zip(differ, slack)]
    salts = [[salt(k + 1) for k in range(len(ends))], [salt(~k) for k in range(len(ends))]]
    _CLASSES[percent] = np.array(ends), np.array(fragments), np.array(slack), np.array(salts[0], U), np.array(salts[1], U)
    return _CLASSES[percent]


def signatures(grams: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets' segments and the number of the set that each is from: in the set's own class of sizes, and in those
    larger ones that hold possible partners."""
    ends, fragments, slack, salts, prefix_salts = size_classes(percent)
    doc, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    k, sigs, owners = np.searchsorted(ends, n), [], []
    here = n > 0
    while True:
        mine = here[doc]
        g, d = grams[mine], doc[mine]
        if not len(g):
            return (np.concatenate(sigs), np.concatenate(owners)) if sigs else (np.zeros(0, U), np.zeros(0, np.int64))
        cut = (g >> U(32)) * fragments[k[d]].astype(U) >> U(32)
        first = np.flatnonzero(np.concatenate(([True], (cut[1:] != cut[:-1]) | (d[1:] != d[:-1]))))
        segment, owner = np.add.reduceat(mixed_bits(g ^ U(0x5DEECE66D)), first), d[first]
        sigs.append(mixed_bits(mixed_bits(segment + salts[k[owner]]) + cut[first]))
        owners.append(owner)
        empty = fragments[k] - np.bincount(owner, minlength=len(n))
        sparse = here & (empty > slack[k])
        rank = np.arange(len(grams)) - start[doc]
        early = sparse[doc] & (rank <= n[doc] - -(-percent * n[doc] // 100))
        sigs.append(mixed_bits(mixed_bits(grams[early]) + prefix_salts[k[doc[early]]]))
        owners.append(doc[early])
        here = here & (100 * n >= percent * (ends[k] + 1)) & (k + 1 < len(ends))
        k = np.minimum(k + 1, len(ends) - 1)


def parity_sketch(grams: np.ndarray) -> bytes:
    """A bit for each of a power of two of cells: the parity of the elements in it."""
    bits = 1 << max(8, (len(grams) - 1).bit_length())
    cells = np.bincount((mixed_bits(grams + GOLD) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def _per_text(docs: DataFrame, text_col: str, schema: str, make) -> DataFrame:
    """make(batch, state) yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for whole in batches:
            for b in pieces(whole, text_col, PIECE):
                yield from make(b, state)

    return docs.mapInArrow(run, schema)


ROWS = "sig long, set_id long, doc_id long, n long"


def signature_rows(docs: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """(sig, set_id, doc_id, n): a row for each document, with n (set_id null where there are no words), and one for each signature of its
    set, without doc_id and n. A task skips signatures of sets that it has seen lately."""

    def make(b, state):
        seen = state.setdefault("seen", set())
        if len(seen) > 200_000:
            seen.clear()
        grams, n = gram_sets(b[text_col], width)
        ids = set_ids(grams, n)
        own = pa.array(ids, mask=n == 0)
        yield pa.RecordBatch.from_arrays([pa.array(mixed_bits(ids.view(U)).view(np.int64)), own, b["doc_id"], pa.array(n, pa.int64())], names=["sig", "set_id", "doc_id", "n"])
        new = np.zeros(len(n), bool)
        new[np.unique(ids, return_index=True)[1]] = True
        new &= np.array([i not in seen for i in ids.tolist()], bool) & (n > 0)
        seen.update(ids[new].tolist())
        sig, owner = signatures(grams[np.repeat(new, n)], n[new], percent)
        owner = ids[new][owner] if len(owner) else owner
        for k in range(0, len(sig), 100_000):
            part = pa.array(sig[k:k + 100_000].view(np.int64)), pa.array(owner[k:k + 100_000])
            none = pa.nulls(len(part[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([*part, none, none], names=["sig", "set_id", "doc_id", "n"])

    return _per_text(docs, text_col, ROWS, make)


def shared(rows: DataFrame) -> DataFrame:
    """The documents' rows as they are, and (sig, set_id, leader) for signatures of two or more sets; leader is the smallest.
    One pass over sorted rows; a group of any size needs constant memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig = last_id = leader = None
        pending = False  # the open group's first row waits for a second one
        names = ["sig", "set_id", "leader", "doc_id", "n"]
        for b in batches:
            is_doc = pc.is_valid(b["n"])
            docs = b.filter(is_doc)
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([docs["sig"], docs["set_id"], pa.nulls(docs.num_rows, pa.int64()), docs["doc_id"], docs["n"]], names=names)
            b = b.filter(pc.invert(is_doc))
            if not b.num_rows:
                continue
            sig, own = b["sig"].to_numpy(), b["set_id"].to_numpy()
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
            new[0] = last_sig is None or sig[0] != last_sig or own[0] != last_id
            sig, own = sig[new], own[new]
            if not len(sig):
                continue
            goes_on = last_sig is not None and sig[0] == last_sig
            first = np.concatenate(([0], np.flatnonzero(sig[1:] != sig[:-1]) + 1))
            size = np.diff(np.concatenate((first, [len(sig)])))
            lead = own[first].copy()
            if goes_on:
                lead[0] = leader
            keep = size > 1
            keep[0] |= goes_on
            rows_kept = np.repeat(keep, size)
            out = [sig[rows_kept], own[rows_kept], np.repeat(lead, size)[rows_kept]]
            if goes_on and pending:
                out = [np.concatenate(([v], o)) for v, o in zip((last_sig, leader, leader), out)]
            last_sig, last_id, leader = sig[-1], own[-1], lead[-1]
            pending = not keep[-1]
            if len(out[0]):
                none = pa.nulls(len(out[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([*[pa.array(o, pa.int64()) for o in out], none, none], names=names)

    by_sig = rows.repartition("sig").sortWithinPartitions("sig", "set_id")
    return by_sig.mapInArrow(run, "sig long, set_id long, leader long, doc_id long, n long")


def gram_table(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(set_id, n, part, sketch, grams): a row for each set and coarse fragment of the order; the sketch is in the first one's."""
    cuts = np.arange(1, PARTS, dtype=U) * U((1 << 64) // PARTS)

    def make(b, state):
        grams, n = gram_sets(b[text_col], width)
        some = n > 0
        stops = np.cumsum(n)[some].tolist()
        sketches, ends = [], [0]
        for a, z in zip([0, *stops], stops):
            g = grams[a:z]
            sketches += [parity_sketch(g), *[None] * (PARTS - 1)]
            ends += [a + c for c in [*np.searchsorted(g, cuts).tolist(), z - a]]
        each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams.view(np.int64)))
        ids, parts = np.repeat(set_ids(grams, n)[some], PARTS), np.tile(np.arange(PARTS, dtype=np.int32), len(stops))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.repeat(n[some], PARTS), pa.int64()), pa.array(parts), pa.array(sketches, pa.binary()), each],
            names=["set_id", "n", "part", "sketch", "grams"],
        )

    return _per_text(docs, text_col, "set_id long, n long, part int, sketch binary, grams array<long>", make)


def sketches_of(grams: DataFrame) -> DataFrame:
    return grams.where("part = 0").select("set_id", "n", "sketch")


def partial_overlaps(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, part, o): the elements that a pair's sets share in one fragment, for each fragment by itself."""
    one = grams.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), "part", F.col("grams").alias("g_a"))
    two = grams.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), "part", F.col("grams").alias("g_b"))
    each = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    halves = each.join(one.hint("merge"), ["a", "part"]).join(two.hint("merge"), ["b", "part"])
    return halves.select("a", "b", "n_a", "n_b", "part", F.size(F.array_intersect("g_a", "g_b")).cast("long").alias("o"))


def verified(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: partial overlaps summed per pair."""
    total = partial_overlaps(pairs, grams).groupBy("a", "b").agg(F.sum("o").alias("o"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    return total.where(100 * F.col("o") >= percent * (F.col("n_a") + F.col("n_b") - F.col("o"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b) but the roots, root being the smallest node reachable.

    Alternating stars: each node's larger neighbours, then its smaller ones, are linked to its smallest. Ends when a
    round changes nothing; each round's links are written, so lineage stays short.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = written(links.where("a <> b").select(most.alias("u"), least.alias("v")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    old = mark(now)
    while old[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        # the smallest are written before they are joined: then few go to all tasks, and of many Spark splits a hub's neighbours
        low = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "low")
        large = written(met(both, low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large")
        dropped(low)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = met(large, low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, now = now, written(small.distinct(), "links")
        dropped(last, low, large)
        new = mark(now)
        if new == old:
            break
        old = new
    back = now.toDF("node", "root")
    back._table_path = now._table_path
    return back


def in_components(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (sig, set_id) of signatures whose sets lie in several components, with comp and the group's size."""
    labelled = rows.select("sig", "set_id").join(roots.withColumnRenamed("node", "set_id").hint("merge"), "set_id", "left")
    labelled = labelled.select("sig", "set_id", F.coalesce("root", "set_id").alias("comp"))
    mixed = labelled.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
    return labelled.join(mixed.where("lo < hi").select("sig", "size").hint("merge"), "sig")


def _fold(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches of one size or several as rows of ``words`` words: halves of a sketch XORed are the sketch of half the size."""
    sizes, out = np.array([len(s) for s in sketches]), np.empty((len(sketches), words), U)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        v = np.frombuffer(b"".join([sketches[i] for i in at]), U).reshape(len(at), -1)
        while v.shape[1] > words:
            v = v[:, : v.shape[1] // 2] ^ v[:, v.shape[1] // 2:]
        out[at] = v
    return out


def possible(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sizes and sketches allow to link: far fewer bytes than their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b["s_a"].to_pylist(), b["s_b"].to_pylist()
            n, m = b["n_a"].to_numpy(), b["n_b"].to_numpy()
            least = np.array([min(len(p), len(q)) for p, q in zip(x, y)], np.int64)
            far = np.zeros(len(x), np.int64)
            for size in np.unique(least):
                at = np.flatnonzero(least == size)
                one, two = (_fold([v[i] for i in at], int(size) // 8) for v in (x, y))
                far[at] = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
            ok = (far <= (n + m) * (100 - percent) // (100 + percent)) & (100 * n >= percent * m) & (100 * m >= percent * n)
            yield pa.RecordBatch.from_arrays([b["a"].filter(pa.array(ok)), b["b"].filter(pa.array(ok))], names=["a", "b"])

    side = lambda x: sketches_of(grams).toDF(x, f"n_{x}", f"s_{x}").hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def close_pairs(comp: np.ndarray, n: np.ndarray, sketches: list[bytes], block: np.ndarray, percent: int, best: bool) -> np.ndarray:
    """Places (i, j) of members of different components that may link. block: members of equal block meet only if there is one block
    (other tiles have them). best: for each member outside the largest component only its best partner."""
    m = _fold(sketches, min(map(len, sketches)) // 8)
    values, back, counts = np.unique(comp, return_inverse=True, return_counts=True)
    main = back == int(np.argmax(counts))
    tiled = len(np.unique(block)) > 1
    order = np.arange(len(n))
    out = []
    for i in (order[~main] if best else order):
        other = comp != comp[i]
        if not best:
            other &= order > i
        if tiled:
            other &= block != block[i]
        other &= (100 * n >= percent * n[i]) & (100 * n[i] >= percent * n)
        j = np.flatnonzero(other)
        if not len(j):
            continue
        far = np.bitwise_count(m[j] ^ m[i]).sum(axis=1, dtype=np.int64)
        allowed = (n[j] + n[i]) * (100 - percent) // (100 + percent)
        ok = far <= allowed
        if not ok.any():
            continue
        if best:
            out.append((i, j[np.argmin(far - allowed)]))
        else:
            out += [(i, q) for q in j[ok]]
    return np.array(out, np.int64).reshape(-1, 2)


def between_components(rows: DataFrame, grams: DataFrame, percent: int, best: bool) -> DataFrame:
    """Candidate pairs (a < b) between components, distinct. A group of more than BLOCK sets is dealt to tiles of two blocks each."""
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("set_id"), blocks)
    tiles = F.when(blocks == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.least(k, own) * blocks + F.greatest(k, own))
    )
    dealt = rows.withColumns({"block": own, "tile": F.explode(tiles)})
    sized = dealt.join(sketches_of(grams).hint("merge"), "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        found: set[tuple[int, int]] = set()

        def close() -> None:
            if len(held) > 1:
                ids, comp, n, block = (np.array([r[k] for r in held], np.int64) for k in (0, 1, 2, 4))
                blocks_here = np.unique(block)
                # a tile of a block with itself holds that block only
                pairs = close_pairs(comp, n, [r[3] for r in held], block if len(blocks_here) > 1 else np.zeros_like(block), percent, best)
                found.update((min(a, b), max(a, b)) for a, b in ids[pairs].tolist())
            held.clear()

        def batch() -> pa.RecordBatch:
            a, b = zip(*found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            cols = [b[c].to_pylist() for c in ("sig", "tile", "set_id", "comp", "n", "sketch", "block")]
            for sig, tile, *rest in zip(*cols):
                if (sig, tile) != key:
                    close()
                    key = (sig, tile)
                held.append(tuple(rest))
            if len(found) > 500_000:
                yield batch()
        close()
        if found:
            yield batch()

    by_tile = sized.repartition("sig", "tile").sortWithinPartitions("sig", "tile")
    return by_tile.select("sig", "tile", "set_id", "comp", "n", "sketch", "block").mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Sets link when 100 * intersection >= percent * union; component_id is the smallest doc_id reachable by links.
    Null texts and texts without words have an empty set and are linked with nothing. Rows with a null doc_id are
    linked with nothing and have a null component_id. Repeated rows are returned each; rows of one doc_id with
    different texts count as different sets of one document. Very long texts are taken whole. An empty table gives an
    empty result. Sets, signatures and components are told apart by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with one_use(docs.sparkSession, BATCHES):
        return _components_of(docs, width, percent)


def _components_of(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """jaccard_components() of (doc_id, text), in a table."""
    all_rows = written(shared(signature_rows(docs, "text", width, percent)), "shared")
    sets = all_rows.where("n is not null").select("doc_id", "n", "set_id")
    rows = all_rows.where("n is null").select("sig", "set_id", "leader")
    reps = sets.where("doc_id is not null and set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    wanted = rows.select("set_id").distinct().join(reps.hint("merge"), "set_id").select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.where("doc_id is not null").join(wanted.hint("merge"), "doc_id", "left_semi")
    grams = written(gram_table(texts, "text", width), "grams")
    first = rows.where("leader <> set_id").select(F.col("leader").alias("a"), F.col("set_id").alias("b")).distinct()
    pairs = written(possible(first, grams, percent), "pairs")
    links = written(verified(pairs, grams, percent), "linked")
    roots, open_rows = components(links), rows
    dropped(pairs, links)
    for best in (True, False):
        last, open_rows = open_rows, written(in_components(open_rows, roots), "open")
        pairs = written(between_components(open_rows, grams, percent, best), "pairs")
        more = written(verified(pairs, grams, percent), "linked")
        old, roots = roots, components(roots.toDF("a", "b").unionByName(more))
        dropped(pairs, more, old, *([last] if last is not rows else []))
    dropped(grams, open_rows)
    of_set = reps.join(roots.withColumnRenamed("node", "set_id").hint("merge"), "set_id", "left").select("set_id", "rep", F.coalesce("root", "set_id").alias("root"))
    lowest = of_set.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_set = of_set.join(lowest.hint("merge"), "root").select("set_id", "component_id")
    out = sets.join(of_set.hint("merge"), "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    found = written(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "components")
    dropped(all_rows, roots)
    return found


def one_of_each(docs: DataFrame, text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the smallest doc_id stays.

    Rows without a doc_id, and texts that are null, empty or without words, stay: they are linked with nothing. Of several rows of
    one doc_id and text one stays, that of the smallest hash of all columns. Very long texts are compared whole. Columns of
    any names are passed on. An empty table gives an empty result. Few documents that go are sent to every task, so that texts
    aren't shuffled; many are merged.
    """
    found = jaccard_components(docs, text_col, width, percent).where("doc_id is not null")
    per = written(found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("n")), "chosen")
    stay = met(docs, per.where(~F.col("first")).select("doc_id"), "doc_id", "left_anti")
    several = written(per.where("first and n > 1").select("doc_id"), "several")
    if several.isEmpty():
        return stay
    rows = met(stay, several, "doc_id", "left_semi").withColumns({"__text": F.xxhash64(text_col), "__all": content_hash(stay, 3)})
    least = rows.groupBy("doc_id", "__text").agg(F.min("__all").alias("__all"))
    one = rows.join(least, ["doc_id", "__text", "__all"], "left_semi").dropDuplicates(["doc_id", "__text", "__all"])
    return met(stay, several, "doc_id", "left_anti").unionByName(one.select(*docs.columns))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op8_ngram_join": op8_ngram_join}
ORACLE = {
    "op8_ngram_join": r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
grams as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from words),
sized as (select doc_id, len(g)::bigint as n from grams),
each as (select doc_id, unnest(g) as g from grams),
met as (select a.doc_id as a, b.doc_id as b, count(*) as o from each a join each b on a.g = b.g and a.doc_id < b.doc_id group by all),
linked as (
  select a, b from met join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)),
both_ways as (select a, b from linked union select b, a from linked),
reach as (
  select doc_id, doc_id as r from sized
  union
  select reach.doc_id, b from reach join both_ways on reach.r = both_ways.a)
select s.doc_id, s.n as n_shingles, min(r.r) as component_id from sized s join reach r on s.doc_id = r.doc_id group by s.doc_id, s.n
""",
}
