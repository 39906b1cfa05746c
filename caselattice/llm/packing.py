"""Packing into optimal length buckets.

The lengths' global histogram decides, by dynamic programming, at which lengths the buckets end so that padding is
least; token-budget batches form inside each bucket, in a seeded random order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import content_hash, documents, n_words, numbered_rows, told_apart, unit_hash, written

CHUNK = 50_000


def best_ends(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """The buckets' ends with the least padding: sum of (end - length) over all rows. lengths: ascending, distinct.

    One layer a bucket; since the best cut doesn't fall as the end grows, a layer is solved by halves, all nodes of a level at
    once: about m log m steps a layer for m lengths.
    """
    m = len(lengths)
    k = min(n_buckets, m)
    if not k:
        return []
    c = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)
    size = lengths.astype(float)
    best, choice = size * c[1:] - s[1:], []  # one bucket over the first j + 1 lengths
    for _ in range(1, k):
        new, cut = best.copy(), np.full(m, -1)
        lo, hi, a, b = (np.array([x]) for x in (0, m - 1, 0, m - 1))
        while len(lo):
            j = (lo + hi) // 2
            n = np.minimum(b, j - 1) - a + 1  # buckets before end at a, a + 1, ...
            at = a.copy()
            some = np.flatnonzero(n > 0)
            if len(some):
                width = n[some]
                first = np.cumsum(width) - width
                i = np.arange(width.sum()) - np.repeat(first - a[some], width)
                end = np.repeat(j[some], width)
                cost = best[i] + size[end] * (c[end + 1] - c[i + 1]) - (s[end + 1] - s[i + 1])
                least = np.minimum.reduceat(cost, first)
                hit = np.flatnonzero(cost == np.repeat(least, width))
                owner = np.repeat(np.arange(len(some)), width)[hit]
                q = i[hit[np.unique(owner, return_index=True)[1]]]
                at[some] = q
                better = least < new[j[some]]
                new[j[some][better]], cut[j[some][better]] = least[better], q[better]
            left, right = lo < j, j < hi
            lo, hi, a, b = (np.concatenate(x) for x in ((lo[left], j[right] + 1), (j[left] - 1, hi[right]), (a[left], at[right]), (at[left], b[right])))
        best = new
        choice.append(cut)
    ends, j = [], m - 1
    for cut in reversed(choice):
        ends.append(int(lengths[j]))
        if cut[j] < 0:
            continue
        j = int(cut[j])
    return sorted({*ends, int(lengths[j])})


def histogram(base: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct lengths, ascending, and the number of rows of each, exact. It grows with the lengths, not the rows: m distinct
    lengths need m * m / 2 tokens, so 10^13 tokens have fewer than 5 million, 16 bytes each."""
    found = base.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    lengths, counts = found["n_tokens"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(lengths)
    return lengths[order], counts[order]


def packed(
    docs: DataFrame, length: Column | None = None, text_col: str = "text", n_buckets: int = 16, token_budget: int = 65_536, seed: int = 31, carry: list[str] | None = None
) -> DataFrame:
    """Each row with n_tokens, bucket, bucket_len, batch, slot and padding.

    length: tokens of a row (default: words; a null text has none). A batch holds as many rows as fit its budget at the
    bucket's padded length, and one row where even that doesn't fit (``oversize``). Batches of a bucket are numbered
    from 0 and all but its last are full. Rows without tokens share a bucket of length 0, of ``token_budget`` rows a
    batch. Negative lengths count as 0. Null and repeated ids are no matter: rows equal in
    every column are alike. The order is the same however the input is laid out in files. An empty table gives an empty
    result. Added columns replace columns of the same names. A hot bucket, or many rows equal in every column, are ranked
    in chunks of about CHUNK rows.
    """
    added = ["n_tokens", "bucket", "bucket_len", "batch", "slot", "padding", "oversize"]
    carry = [c for c in (carry or docs.columns) if c not in added]
    n = (n_words(F.col(text_col)) if length is None else F.greatest(F.coalesce(length, F.lit(0)), F.lit(0))).cast("long")
    base = docs.select(F.struct(*carry).alias("rec") if carry else F.struct(F.lit(0)).alias("rec"), n.alias("n_tokens"), content_hash(docs, seed).alias("dice"))
    base = written(numbered_rows(base), "pack")
    lengths, counts = histogram(base)
    some = lengths > 0
    ends = best_ends(lengths[some], counts[some], n_buckets)
    if not some.all():
        ends = [0, *ends]
    totals = np.diff(np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.searchsorted(lengths, ends, side="right")))]).tolist() if ends else []
    base = told_apart(base)
    array = lambda xs, t: F.array(*[F.lit(x) for x in xs]).cast(f"array<{t}>")
    bucket = F.size(F.filter(array(ends, "long"), lambda e: e < F.col("n_tokens")))
    at = lambda xs, t: F.get(array(xs, t), F.col("bucket"))
    dealt = base.withColumn("bucket", bucket).withColumns({
        "bucket_len": at(ends, "long"), "chunks": at([max(1, -(-t // CHUNK)) for t in totals], "long"), "dice": unit_hash(seed, F.col("dice")),
    })
    dealt = dealt.withColumn("chunk", F.floor(F.col("dice") * F.col("chunks")))
    before = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bucket", "chunk").agg(F.count("*").alias("n")).select("bucket", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("dice")) - 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest("bucket_len", F.lit(1))))
    pos = F.col("start") + F.col("rank")
    return ranked.join(starts, ["bucket", "chunk"]).select(
        *([F.col(f"rec.`{c}`").alias(c) for c in carry]), "n_tokens", "bucket", "bucket_len",
        F.floor(pos / room).alias("batch"), (pos % room).alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"), (F.col("bucket_len") > token_budget).alias("oversize"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokens being words; 16 buckets, batches of 65,536 tokens."""
    return packed(documents(spark, sf_dir).select("doc_id", "text"), carry=["doc_id"])


QUERIES = {"op6_packing": op6_packing}
ORACLE: dict[str, str] = {}
