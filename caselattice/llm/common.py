"""Shared helpers: intermediate tables that every executor can read, and text primitives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import dropped, few, met, one_use, shared_dir, table_path, written  # noqa: F401

#: The ASCII white space that separates words, as characters and as a pattern of words.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is. Pure ASCII texts take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def n_words(text: Column) -> Column:
    """Number of words as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: int, *cols: Column) -> Column:
    """A seeded uniform number in [0, 1) from the values of cols."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def content_hash(df: DataFrame, seed: int) -> Column:
    """A seeded 64-bit hash of a row's values (maps left out): the same wherever the row lies in the input."""
    return F.xxhash64(F.lit(seed), *[df[c] for c, t in df.dtypes if "map<" not in t])


def numbered_rows(df: DataFrame) -> DataFrame:
    """df with ``rid``, a number of each row that must be written before it is used."""
    return df.withColumn("rid", F.monotonically_increasing_id())


def told_apart(base: DataFrame, often: int = 1000) -> DataFrame:
    """base with other ``dice`` for rows that share theirs with more than ``often`` others (rows equal in every column).

    base is a written table with ``dice`` and ``rid`` of numbered_rows(). Of such rows each gets its own number among them, from
    counts by input task, and the dice of both: the same set of dice however the input is laid out, and no task ever
    holds more of them than one input task did.
    """
    hot = written(base.groupBy("dice").agg(F.count("*").alias("n")).where(F.col("n") > often).select("dice"), "repeated")
    if hot.isEmpty():
        return base
    part = F.shiftright("rid", 33)
    rows = met(base, hot, "dice", "left_semi").withColumn("__part", part)
    sizes = rows.groupBy("dice", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("dice").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("dice", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("dice", "__part").orderBy("rid"))
    own = rows.withColumn("__i", place).join(starts, ["dice", "__part"])
    own = own.withColumn("dice", F.xxhash64("dice", F.col("__start") + F.col("__i"))).select(*base.columns)
    return met(base, hot, "dice", "left_anti").select(*base.columns).unionByName(own)


def starts_of(counts: DataFrame, key: str, group: int = 4096) -> DataFrame:
    """(key, start): the sum of ``n`` over all smaller keys (0, 1, ...). One row a group of keys meets in one task."""
    at = counts.withColumn("__g", F.floor(F.col(key) / group))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy("__g").agg(F.sum("n").alias("__n"))
    sums = sums.select("__g", F.coalesce(F.sum("__n").over(before(Window.orderBy("__g"))), F.lit(0)).alias("__s"))
    inner = F.coalesce(F.sum("n").over(before(Window.partitionBy("__g").orderBy(key))), F.lit(0))
    return at.withColumn("__i", inner).join(sums, "__g").select(key, (F.col("__s") + F.col("__i")).alias("start"))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
