"""Places inside groups, without a group in one task."""

import random

from pyspark.sql import functions as F

from caselattice.functions import rows
from caselattice.operators import geometry


def test_places_in_hot_groups(spark):
    rng = random.Random(2)
    data = [(rng.choice([None, "a", "a", "a", "b", f"g{i}"]), rng.choice([None, 1.0, 2.0, rng.random()]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, x double, id long").repartition(7)
    got = {r.id: r.place for r in rows.numbered_within(df, "g", [F.col("x"), F.col("id")], "place").collect()}
    by = {}
    for g, x, i in data:
        by.setdefault(g, []).append((x is not None, x or 0.0, i))
    assert got == {i: n + 1 for own in by.values() for n, (_, _, i) in enumerate(sorted(own))}
    assert rows.numbered_within(df.where("false"), "g", [F.col("id")], "place").count() == 0


def test_core_members_of_one_large_group(spark):
    """All points in one group of equal distances: the smallest ids stay."""
    pts = spark.range(1000, numPartitions=6).select("id", F.lit(0).alias("label"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    got = geometry.core_members(pts).collect()
    assert sorted(r.id for r in got) == list(range(700)) and sorted(r["rank"] for r in got) == list(range(1, 701))
