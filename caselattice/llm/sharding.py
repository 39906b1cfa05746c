"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit in memory, by a seeded hash of each record, and writes
them to the shared folder. Pass 2 gives each bucket a Fisher-Yates shuffle (Spark's
``shuffle``), lays the buckets end to end and cuts the sequence into shards of equal length.

All records of a bucket are handled by one task, so a bucket is bounded in bytes: their number follows from the
written table's size and the executors' memory, and is at least that of the session's shuffle partitions, so that all
cores take part. The hash takes in all of a record's columns, and many records equal in all of them are told apart, so
records of one hot key or copies of one text spread like any others; the order doesn't depend on how the input is laid
out in files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import MOST_BROADCAST
from .common import content_hash, documents, numbered_rows, starts_of, told_apart, written

#: A bucket is held about this many times while it is shuffled (rows, sorted rows, shuffled rows, in objects).
TIMES_HELD = 12


def bucket_size(spark: SparkSession) -> int:
    """Bytes of a bucket, from the memory and cores of an executor: 8 to 512 MiB."""
    conf = spark.sparkContext.getConf()
    memory = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsMb(conf.get("spark.executor.memory", "1g")) << 20
    cores = int(conf.get("spark.executor.cores", "0")) or 4
    return min(max(memory // (cores * TIMES_HELD), 8 << 20), 512 << 20)


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def scatter(df: DataFrame, size: Column, seed: int) -> DataFrame:
    """Pass 1, first half: the records with their size and seeded hash, in the shared folder."""
    base = df.select(F.struct(*[df[c] for c in df.columns]).alias("rec"), size.alias("rec_size"), content_hash(df, seed).alias("dice"))
    return written(numbered_rows(base), "scatter")


def _shuffled(df: DataFrame, size: Column | None, seed: int, bucket_bytes: int | None) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    base = scatter(df, record_size(F.col("text")) if size is None else size, seed)
    sums = base.agg(F.sum("rec_size").alias("bytes"), F.count("*").alias("n")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(1, -(-int(sums["bytes"] or 0) // (bucket_bytes or bucket_size(spark))), min(least, sums["n"]))
    base = told_apart(base).withColumn("bucket", F.pmod(F.col("dice"), F.lit(n_buckets)).cast("int"))
    starts = starts_of(base.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    # a task a bucket: the bucket's number is the partition's
    dealt = base.select("bucket", "dice", "rec_size", "rec").repartitionById(n_buckets, F.col("bucket")).groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("dice", "rec_size", "rec"))).alias("recs")
    )
    mixed = dealt.select("bucket", F.expr(f"shuffle(recs, {seed})").alias("recs"))
    # records stay where they are: few starts go to every task, many to their bucket's
    starts = F.broadcast(starts) if n_buckets <= MOST_BROADCAST else starts.repartitionById(n_buckets, F.col("bucket"))
    out = mixed.join(starts, "bucket").select("start", F.posexplode("recs").alias("i", "r"))
    return out.select(F.col("r.rec").alias("rec"), F.col("r.rec_size").alias("rec_size"), (F.col("start") + F.col("i")).alias("pos")), sums["n"]


def shuffled(df: DataFrame, size: Column | None = None, seed: int = 17, bucket_bytes: int | None = None) -> DataFrame:
    """Every record once, in a column ``rec`` (struct), with ``rec_size`` and its place ``pos`` (0..n-1) in the new order.

    bucket_bytes: bytes of a bucket (from the executors' memory). Null values, empty and very long texts and repeated
    records are moved like any others; extra columns stay in ``rec`` under their own names. An empty input gives no rows.
    A record larger than a bucket makes its bucket larger by that much. Reruns give the same order under the same settings.
    """
    return _shuffled(df, size, seed, bucket_bytes)[0]


def cut(shuffled_df: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """Shard and slot of every record: shards of equal length, the first ones longer by one."""
    base, extra = divmod(n_rows, n_shards)
    pos, edge = F.col("pos"), extra * (base + 1)
    late = pos - edge
    first = pos < edge
    return shuffled_df.withColumn(
        "shard", F.when(first, F.floor(pos / (base + 1))).otherwise(extra + F.floor(late / max(base, 1))).cast("int")
    ).withColumn("slot", F.when(first, pos % (base + 1)).otherwise(late % max(base, 1)).cast("long"))


def sharded(df: DataFrame, n_shards: int, size: Column | None = None, seed: int = 17, bucket_bytes: int | None = None) -> DataFrame:
    """``rec``, ``rec_size``, ``shard`` and ``slot`` of every record of df: shuffled(), cut into shards whose counts are at most one apart.

    Nulls, empty and very long texts, repeated records and clashing names as in shuffled(). With fewer records than
    shards the last shards are empty; an empty table gives an empty result.
    """
    out, n = _shuffled(df, size, seed, bucket_bytes)
    return cut(out, n, n_shards)


def write_shards(sharded_df: DataFrame, path: str) -> None:
    """One folder a shard, its records in slot order.

    A shard is one task's sorted output, which spills: texts may be null, empty or long and records repeated. Columns
    ``shard`` and ``slot`` of the records themselves would clash and raise an error. An empty table writes no shard.
    """
    (
        sharded_df.repartition("shard").sortWithinPartitions("shard", "slot").select("shard", "slot", "rec.*")
        .write.partitionBy("shard").parquet(path)
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the law ``rows``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = sharded(docs, 40)
    return out.select(
        F.col("rec.doc_id").alias("doc_id"),
        F.col("rec_size").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("rec.text"), F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op2_sharding": op2_sharding}
ORACLE: dict[str, str] = {}
