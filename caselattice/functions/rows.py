"""Row numbers without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import met, written


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with row numbers from 1 in its own order: each partition's rows follow those of the partitions before it.

    One count a partition reaches the driver. The rows are written, since a sort run anew may choose other partition bounds
    than the ones that were counted.
    """
    at = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    at = written(at, "numbered")
    sizes = {r["__p"]: r["count"] for r in at.groupBy("__p").count().collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    start = F.get(F.lit(starts).cast("array<long>") if starts else F.array().cast("array<long>"), F.col("__p"))
    return at.withColumn(name, start + F.col("__i") + 1).drop("__p", "__i")


def numbered_within(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """df with each row's place from 1 among its group's rows in an order, null groups being one. No group meets in one task.

    Rows are sorted by range over group and order, numbered in their partitions, and moved on by the counts of the group in the
    partitions before. Ties take any order, so order should be total; a group costs one number a partition.
    """
    base = written(df, "unsorted")  # a sort run anew must see the same rows
    at = base.orderBy(F.col(group).asc_nulls_first(), *order)
    at = at.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    at = written(at, "sorted")
    counts = at.groupBy("__p", group).agg(F.count("*").alias("n"), F.min("__i").alias("first"))
    before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.struct("__p", F.col(group).alias("g")).alias("__at"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__start"))
    out = met(at.withColumn("__at", F.struct("__p", F.col(group).alias("g"))), written(starts, "starts"), "__at")
    return out.withColumn(name, F.col("__start") + F.col("__i") + 1).drop("__at", "__start", "__i", "__p")
