"""Quality rules with host-level verdicts.

Each text is measured once (vectorised, on Arrow batches), rule failures are summed by host, each host's failure rates are
shrunk with a beta prior fitted to all hosts, and the verdicts are joined back to the documents. A host of which most
documents surely fail goes as a whole. A host that fails a rule more often than the corpus does is held to that rule:
its documents that fail it go, while in other hosts they stay. So verdicts decide without taking a host's clean
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, documents, few, written

SYMBOLS = "[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Host rules: failures of a document, as SQL over the measures.
HOST_RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "same_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE_RULE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
MOST_BROADCAST = 100_000


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts, and the number of the text that each is from."""
    lists = pc.ascii_split_whitespace(texts)
    words, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real), doc.filter(real).to_numpy()


def repeated_positions(codes: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 3) -> np.ndarray:
    """For each text, the number of words inside windows of ``width`` words that occur twice or more in it."""
    n = len(codes) - width + 1
    if n < 2:
        return np.zeros(n_docs, np.int64)
    inside = doc[:n] == doc[width - 1:]
    ids = codes[:n].astype(np.int64)
    for k in range(1, width):  # pairs, triples ... as dense numbers, so that they never overflow
        wide = ids * (int(codes.max()) + 1) + codes[k:n + k]
        ids = np.unique(wide, return_inverse=True)[1] if k < width - 1 else wide
    ids = np.unique(ids, return_inverse=True)[1]
    at = np.flatnonzero(inside)
    key = doc[at].astype(np.int64) * (int(ids.max()) + 1) + ids[at]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[back] > 1]
    hit = np.zeros(len(codes), bool)
    for k in range(width):
        hit[twice + k] = True
    return np.bincount(doc[hit], minlength=n_docs)


def repeated_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the lines with a word that equal an earlier line, and the number of lines."""
    lists = pc.split_pattern(texts, "\n")
    lines, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    real = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    codes = lines.dictionary_encode().indices.to_numpy()
    codes, where = codes[real], doc[real]
    key = where.astype(np.int64) * (int(codes.max()) + 1 if len(codes) else 1) + codes
    own = np.unique(key, return_index=True)[1]
    return np.bincount(where, minlength=len(texts)) - np.bincount(where[own], minlength=len(texts)), np.bincount(doc, minlength=len(texts))


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text; a null text counts as empty."""
    texts = pc.fill_null(texts, "")
    words, doc = split_words(texts)
    n = len(texts)
    dup, lines = repeated_lines(texts)
    codes = words.dictionary_encode().indices.to_numpy()
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": np.bincount(doc, weights=pc.utf8_length(words).to_numpy(), minlength=n).astype(np.int64),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_positions(codes, doc, n),
        "n_lines": lines,
    }


def pieces(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy())
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_measures(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with the measures as long columns (they replace columns of the same names)."""
    docs = docs.drop(*MEASURES)
    keep = [c for c in docs.columns if not (drop_text and c == text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, text_col):
                found = measured(b[text_col])
                yield pa.RecordBatch.from_arrays(
                    [b[c] for c in keep] + [pa.array(found[m], pa.int64()) for m in MEASURES], names=[*keep, *MEASURES]
                )

    schema = docs.select(*keep, *[F.lit(0).cast("long").alias(m) for m in MEASURES]).schema
    return docs.mapInArrow(run, schema)


def host_of(c: Column) -> Column:
    """The domain, A-Z lower-cased, of a value with ://; any other value is a host by itself."""
    domain = F.regexp_extract(c, r"(?s)://([^/?#]*)", 1)
    return F.when(F.contains(c, F.lit("://")), F.translate(domain, UPPER, UPPER.lower())).otherwise(c)


def beta_prior(n_hosts: int, docs: int, docs2: int, failed: int, spread: float) -> float | None:
    """The weight (alpha + beta) of the hosts' beta prior, in documents, by the moments of a beta-binomial; None (infinite) if hosts don't differ.

    docs and docs2: the sum of the hosts' documents and of their squares; spread: the sum of n * (rate - mean) ** 2. What
    equal hosts would spread by chance alone is taken off first. One host says nothing of the spread: a weak prior of two documents.
    """
    if n_hosts < 2:
        return 2.0
    noise = failed / docs * (1 - failed / docs)
    room = noise * (docs - docs2 / docs - (n_hosts - 1))
    excess = spread - (n_hosts - 1) * noise
    if room <= 0 or excess <= 0:
        return None
    return max(room / excess - 1, 0.0)


#: The chance that any host is held to a rule, or goes, though it fails no more often than the corpus, or than MOST.
BY_CHANCE, MOST = 0.05, 0.5


def host_verdicts(measures: DataFrame, host_col: str = "source", most: float = MOST) -> DataFrame:
    """(host, n, for each rule its rate and whether the host is held to it (``strict``), host_rejected). A null host is a host of its own.

    A rule's rate is the mean of its posterior: the prior of that rule over all hosts, half a document on either side, and the
    host's documents. A rate must lie so many deviations over the bar that BY_CHANCE holds for all hosts and rules together. Where
    hosts don't differ in a rule, its rate is the corpus's and none is held to it. The prior needs six numbers a rule on the driver.
    """
    sums = measures.groupBy(host_of(F.col(host_col)).alias("host")).agg(
        F.count("*").alias("n"), *[F.sum(F.expr(f"cast({rule} as long)")).alias(name) for name, rule in HOST_RULES.items()]
    )
    sums = written(sums, "hosts")
    moments = sums.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("docs"), F.sum(F.col("n").cast("double") * F.col("n")).alias("docs2"), *[F.sum(name).alias(name) for name in HOST_RULES],
        *[F.sum(F.col(name) * F.col(name) / F.col("n")).alias(f"{name}_squares") for name in HOST_RULES],
    ).first()
    hosts, docs = moments["hosts"], moments["docs"]
    bar = NormalDist().inv_cdf(1 - BY_CHANCE / (max(hosts, 1) * len(HOST_RULES)))
    for name in HOST_RULES:
        failed = moments[name] or 0
        corpus = failed / docs if docs else 0.0
        weight = beta_prior(hosts, docs, moments["docs2"], failed, moments[f"{name}_squares"] - failed * corpus) if docs else None
        if weight is None:
            mean, spread, strict = F.lit(corpus), F.lit((corpus * (1 - corpus) / ((docs or 0) + 1)) ** 0.5), F.lit(False)
        else:
            total = F.col("n") + weight + 1
            mean = (F.col(name) + weight * corpus + 0.5) / total
            spread = F.sqrt(mean * (1 - mean) / (total + 1))
            strict = mean - bar * spread > corpus
        sums = sums.withColumns({f"{name}_rate": mean, f"{name}_strict": strict, f"{name}_most": mean - bar * spread > most})
    rejected = reduce(lambda x, y: x | y, [F.col(f"{name}_most") for name in HOST_RULES])
    return sums.select("host", "n", *[f"{name}_{k}" for name in HOST_RULES for k in ("rate", "strict")], rejected.alias("host_rejected"))


def join_verdicts(docs: DataFrame, verdicts: DataFrame, host_col: str = "source", salts: int = 64) -> DataFrame:
    """docs with ``host_rejected`` and ``host_rules`` (the rules that their host is held to).

    Hosts without a verdict against them aren't joined. Few others are broadcast; of many, each is dealt to ``salts`` places so that no
    host fills one task. A null host meets its own verdict; repeated rows and rows of any length pass through; an empty side
    gives false and no rules. Columns of docs named like the added ones are replaced.
    """
    strict = F.array_compact(F.array(*[F.when(F.col(f"{name}_strict"), F.lit(name)) for name in HOST_RULES]))
    bad = verdicts.select(F.col("host").alias("__host"), "host_rejected", strict.alias("host_rules")).where("host_rejected or size(host_rules) > 0")
    docs = docs.drop("host_rejected", "host_rules").withColumn("__own", host_of(F.col(host_col)))
    same = F.col("__own").eqNullSafe(F.col("__host"))
    if bad.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST and few(bad):
        out = docs.join(F.broadcast(bad), same, "left")
    else:
        bad = bad.withColumn("__salt_b", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        docs = docs.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        out = docs.join(bad, same & (F.col("__salt") == F.col("__salt_b")), "left").drop("__salt", "__salt_b")
    return out.drop("__host", "__own").withColumns({"host_rejected": F.coalesce("host_rejected", F.lit(False)), "host_rules": F.coalesce("host_rules", F.array().cast("array<string>"))})


def quality_rules(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", most: float = MOST, keep_text: bool = True
) -> DataFrame:
    """docs with the measures, ``base_failed``, ``host_rejected``, ``host_rules``, ``host_failed`` (a rule that the host is held to) and ``kept``.

    Null texts count as empty and fail for few words. Null hosts are one host. Very long texts are measured whole,
    each in a slice of its own. Repeated rows are measured and counted each. An empty table gives an empty result.
    Added columns replace columns of the same names. With keep_text false the text is left out. Measured rows are written
    once, for the hosts' sums and for the join with the verdicts.
    """
    rows = written(with_measures(docs.drop("base_failed", "host_rejected", "host_rules", "host_failed", "kept"), text_col, drop_text=not keep_text), "measures")
    out = join_verdicts(rows.withColumn("base_failed", F.expr(BASE_RULE)), host_verdicts(rows, host_col, most), host_col)
    failed = reduce(lambda x, y: x | y, [F.array_contains("host_rules", name) & F.expr(rule) for name, rule in HOST_RULES.items()])
    return out.withColumn("host_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected") & ~F.col("host_failed"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return quality_rules(docs, keep_text=False).select("doc_id", *MEASURES[:5], "base_failed", "host_rejected", "host_failed", "kept")


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLE: dict[str, str] = {}
