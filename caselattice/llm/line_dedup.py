"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs) of line keys, each as two 64-bit hashes, with the number of documents that hold it,
in buckets of the key and sorted by it. Documents come in batches, the largest ids first. Each batch is counted to a run
of its own and merge-anti-joined with all runs so far: a key that none of them holds is new, and the largest id of the
batch that holds it is the one where its lines stay. Then the batch's run is added; when a level holds ``fanin`` runs
they are merged into one of the next level. All runs lie in the same buckets, so neither anti-joins nor merges shuffle.
Only hashes travel, counted before they are shuffled; texts are shuffled once, to meet the keys that they lose.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, WHITE, ascii_lower, documents, dropped, met, one_use, table_path, written

KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """The lines of a text, split at newlines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(key: Column, salt: int = 0) -> Column:
    return F.xxhash64(key) if not salt else F.xxhash64(F.lit(salt), key)


def keys_of(text: Column) -> Column:
    """The keys of a text's lines: stripped of white space, A-Z lower-cased."""
    return F.transform(lines_of(ascii_lower(text)), lambda s: F.btrim(s, F.lit(WHITE)))


def doc_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Columns that tell documents apart: the id, or for a null id the text's hash (so null ids don't meet in one task)."""
    i = F.col(id_col)
    return [
        F.coalesce(i, F.lit("0").cast(docs.schema[id_col].dataType)).alias("d_id"),
        F.when(i.isNull(), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(1))).otherwise(F.lit(0)).alias("d_null"),
    ]


def line_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, carry: list[str] | None = None) -> DataFrame:
    """One row for each document and each of its distinct long keys. carry: other columns to pass on."""
    hashes = F.transform(
        F.filter(keys_of(F.col(text_col)), lambda k: F.char_length(k) >= min_chars),
        lambda k: F.struct(line_hash(k).alias("h1"), line_hash(k, 1).alias("h2")),
    )
    each = docs.select(F.col(id_col).alias("id"), *doc_key(docs, id_col, text_col), F.explode(F.array_distinct(hashes)).alias("h"), *(carry or []))
    return each.select("id", "d_id", "d_null", "h.h1", "h.h2", *(carry or []))


def counted(entries: DataFrame) -> DataFrame:
    """A batch's own run, with ``last``, the largest id. Documents without an id count, and rank below all others."""
    return entries.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("last"))


#: While runs meet: with one file a bucket, as here, a bucket is read in the order in which it was written.
AS_RUNS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


class LineRuns:
    """Runs by level. ``fresh`` anti-joins a batch's run with all runs, ``add`` appends it and compacts full levels, ``merged`` is one run of all."""

    def __init__(self, fanin: int = 4):
        self.fanin, self.levels = fanin, [[]]
        self.buckets = 0

    def saved(self, run: DataFrame, name: str) -> DataFrame:
        """run in a table of buckets sorted by key. Rows that already lie in buckets are not shuffled."""
        spark = run.sparkSession
        self.buckets = self.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path, table = table_path(spark, name), f"caselattice_{name}_{uuid.uuid4().hex}"
        with one_use(spark, AS_RUNS):
            run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(table)
        back = spark.table(table)
        back._table_path, back._table = path, table
        return back

    def fresh(self, run: DataFrame) -> DataFrame:
        """The rows of run whose key no run holds."""
        return reduce(lambda df, old: df.join(old.select(*KEY).hint("merge"), KEY, "left_anti"), self.all(), run)

    def add(self, run: DataFrame) -> None:
        """run: a saved() one, which belongs to the runs from now on."""
        self._put(run, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanin:
            old, self.levels[level] = self.levels[level], []
            self._put(self._merge(old), level + 1)

    @staticmethod
    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        """The keys of either run, with the sum of their counts: a merge of two sorted runs, bucket by bucket."""
        sides = [r.select(*KEY, F.col("n_docs").alias(n)) for r, n in ((a, "n_a"), (b, "n_b"))]
        zero = lambda n: F.coalesce(n, F.lit(0))
        return sides[0].join(sides[1].hint("merge"), KEY, "full_outer").select(*KEY, (zero("n_a") + zero("n_b")).alias("n_docs"))

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """One saved run of several, two at a time; they are deleted."""
        while len(runs) > 1:
            made = [self.saved(self.both(a, b), "merged") for a, b in zip(runs[::2], runs[1::2])]
            forgotten(*runs[:2 * len(made)])
            runs = made + runs[2 * len(made):]
        return runs[0]

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def merged(self) -> DataFrame | None:
        """All runs compacted into one."""
        runs = self.all()
        if runs:
            self.levels = [[] for _ in self.levels[1:]] + [[self._merge(runs)]]
        return self.all()[0] if runs else None

    def dedup_batch(self, entries: DataFrame) -> DataFrame:
        """For a feed of batches: the entries whose key no run holds; then adds the batch's own run.

        A key's entries within the batch all stay or all go. Repeated entries stay; keys are never null; an empty batch adds an
        empty run.
        """
        own = self.saved(counted(entries), "batch")
        new = written(entries.join(self.fresh(own).select(*KEY).hint("merge"), KEY, "left_semi"), "fresh")
        self.add(own)
        return new


def forgotten(*tables: DataFrame) -> None:
    """Delete saved() tables."""
    for t in tables:
        t.sparkSession.sql(f"drop table if exists {t._table}")
    dropped(*tables)


def batch_of(docs: DataFrame, id_col: str, n_batches: int) -> Column:
    """The batch of a row: 0 for the largest ids, rows without an id in the last one. Ids that aren't numbers are one batch."""
    if n_batches < 2 or docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return F.lit(0)
    cuts = docs.agg(F.percentile_approx(id_col, [k / n_batches for k in range(1, n_batches)], 1000).alias("c")).first()["c"] or []
    i = F.col(id_col)
    return F.when(i.isNull(), n_batches - 1).otherwise(reduce(lambda a, b: a + b, [(i <= c).cast("int") for c in cuts], F.lit(0)))


def lost_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, n_batches: int, fanin: int) -> DataFrame:
    """(d_id, d_null, lost): for each document that loses lines, the hashes of their keys."""
    batch = batch_of(docs, id_col, n_batches)
    entries = written(line_entries(docs.withColumn("__batch", batch), id_col, text_col, min_chars, ["__batch"]), "entries", "__batch")
    several = not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()
    runs, holders = LineRuns(fanin), []
    for b in range(n_batches):
        each = entries.where(F.col("__batch") == b).drop("__batch")
        if several:  # rows of one id are one document
            each = each.where("id is not null").distinct().unionByName(each.where("id is null"))
        own = runs.saved(counted(each), "batch")
        holders.append(runs.saved(runs.fresh(own).select(*KEY, "last"), "holders"))
        runs.add(own)
    often = runs.merged().where(F.col("n_docs") >= min_docs).select(*KEY)
    with one_use(docs.sparkSession, AS_RUNS):  # each key is in one table of holders
        common = written(reduce(DataFrame.unionByName, [h.where("last is not null").join(often.hint("merge"), KEY) for h in holders]), "common")
    lost = met(entries, common, KEY).where(F.col("id").isNull() | (F.col("id") < F.col("last")))
    lost = written(lost.groupBy("d_id", "d_null").agg(F.collect_set(F.struct(*KEY)).alias("lost")), "lost")
    dropped(entries, common)
    forgotten(*holders, *runs.all())
    return lost


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, n_batches: int = 4, fanin: int = 4
) -> DataFrame:
    """docs with ``n_lines`` (before), ``n_dropped`` and the text without the lines that it loses.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents stays only in the largest id
    that holds it. Rows of one id are one document, each row without an id is one of its own. Null and empty texts
    are one empty line and become empty texts. Rows without an id rank below all ids and lose to them; among themselves they
    keep their lines. Rows that share the largest id all keep theirs. Very long texts and lines are taken whole. An empty table gives an empty result. The other columns are passed on; added columns
    replace columns of the same name.
    """
    lost = lost_keys(docs, id_col, text_col, min_chars, min_docs, n_batches, fanin)
    keys = doc_key(docs, id_col, text_col)
    side = docs.withColumns({"__d_id": keys[0], "__d_null": keys[1]})
    both = side.join(lost.toDF("__d_id", "__d_null", "__lost").hint("merge"), ["__d_id", "__d_null"], "left")
    lines = lines_of(F.col(text_col))
    # ASCII case and white space at the ends don't move newlines, so lines and keys match by place
    kept = F.filter(lines, lambda s: ~F.exists("__lost", lambda k: (k["h1"] == line_hash(_line_key(s))) & (k["h2"] == line_hash(_line_key(s), 1))))
    kept = F.when(F.col("__lost").isNull(), lines).otherwise(kept)
    return both.withColumn("__kept", kept).withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": (F.size(lines) - F.size("__kept")).cast("long"),
        text_col: F.array_join("__kept", "\n"),
    }).drop("__d_id", "__d_null", "__lost", "__kept")


def _line_key(line: Column) -> Column:
    return F.btrim(F.translate(line, UPPER, UPPER.lower()), F.lit(WHITE))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def line_dedup_sql(source: str = "documents") -> str:
    """DuckDB: the documents of a relation with their kept text, as columns doc_id, n_lines, n_dropped, kept."""
    return rf"""
with split_up as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from {source}),
numbered as (
  select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from split_up),
keyed as (
  select doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as k from numbered),
common as (
  select k, max(doc_id) as last from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
judged as (
  select e.doc_id, e.pos, e.line, (c.k is not null and e.doc_id < c.last) as lost from keyed e left join common c on e.k = c.k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where lost)::bigint as n_dropped,
  coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '') as kept
from judged group by doc_id"""


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE = {"op5_line_dedup": f"select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from ({line_dedup_sql()})"}
