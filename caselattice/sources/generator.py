"""Sample registers of any size: cases drawn from a pool of summaries, with dates, departments and severities."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import numbered

#: First date, days, and the shares of severities 1 to 5.
FIRST_DAY, DAYS, SEVERITY_SHARES = "2025-01-06", 365, [10, 22, 32, 24, 12]
DEPARTMENTS = ["Surgery", "Medicine", "Emergency", "Intensive Care", "Children", "Maternity", "Heart", "Theatres"]
TAILS = [" An action has an owner.", " The family was told.", " Logged as an incident.", " A like case came up last month.", " A review was asked for."]
#: By kind, what happened; with places and outcomes it makes a pool where none is given.
HAPPENED = {
    "medicines": ["insulin was given twice", "a blood thinner was not restarted", "the wrong strength was drawn up", "an allergy was missed"],
    "surgery": ["bleeding needed a second operation", "a swab count was wrong", "a join leaked on the fourth day", "the side was marked late"],
    "handover": ["a pending result was not passed on", "two teams each thought the other had called", "the list was a day old", "a plan was said but not written"],
    "devices": ["a pump alarm had been silenced", "the monitor battery died", "a line came apart", "the spare was not charged"],
    "delays": ["the scan was read two days later", "sepsis was not thought of at first", "a bed came after eleven hours", "the referral lay in a tray"],
}
PLACES, OUTCOMES = ["at night", "after a transfer", "on a busy day", "before a weekend", "in the side room"], ["No lasting harm.", "A longer stay.", "Moved to intensive care.", "Found on review.", "Put right the same day."]


def sample_pool(spark: SparkSession) -> DataFrame:
    """(mode, summary): every event at every place with every outcome."""
    rows = [(mode, f"{w[0].upper()}{w[1:]} {p}. {o}") for mode, events in HAPPENED.items() for w in events for p in PLACES for o in OUTCOMES]
    return spark.createDataFrame(rows, "mode string, summary string")


def _drawn(of: Iterable[str], seed: int, salt: int) -> Column:
    values = list(of)
    return F.array(*[F.lit(v) for v in values])[F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "i"), F.lit(len(values))).cast("int")]


def sample_register(spark: SparkSession, rows: int = 100, seed: int = 42, pool: DataFrame | None = None) -> DataFrame:
    """(Case_ID, Date, Department, Case_Summary, Severity_Score, mode) sorted by Date, then Case_ID. pool: (mode, summary).

    Up to the pool's size no summary is drawn twice: row i takes the pool's i-th summary in an order by a seeded hash. Further rows
    draw again, with a tail that tells them apart and their number where tails run out. Every value follows from the seed and
    the row's number, so the rows are the same at any number of partitions. An empty pool or no rows give an empty register.
    """
    pool = (pool if pool is not None else sample_pool(spark)).select("mode", "summary")
    placed = numbered(pool.orderBy(F.xxhash64(F.lit(seed), "mode", "summary"), "mode", "summary"), "place")
    size = placed.count()
    hash_of = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col("i"))
    again = F.col("i") >= size
    each = spark.range(rows if size else 0).withColumnRenamed("id", "i")
    each = each.withColumn("place", F.when(again, F.pmod(hash_of(1), F.lit(max(size, 1)))).otherwise(F.col("i")) + 1)
    tail = F.when(again, F.concat(_drawn(TAILS, seed, 2), F.lit(" ("), F.col("i").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    at, grade = F.pmod(hash_of(5), F.lit(sum(SEVERITY_SHARES))), F.lit(len(SEVERITY_SHARES))
    for g in range(len(SEVERITY_SHARES) - 1, 0, -1):
        grade = F.when(at < sum(SEVERITY_SHARES[:g]), g).otherwise(grade)
    out = each.join(placed, "place").select(
        F.concat(F.lit("MM-2025-"), F.lpad((F.col("i") + 1).cast("string"), F.greatest(F.lit(3), F.char_length((F.col("i") + 1).cast("string"))), F.lit("0"))).alias("Case_ID"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(hash_of(3), F.lit(DAYS)).cast("int")).alias("Date"), _drawn(DEPARTMENTS, seed, 4).alias("Department"),
        F.concat("summary", tail).alias("Case_Summary"), grade.cast("int").alias("Severity_Score"), "mode",
    )
    return out.orderBy("Date", "Case_ID")
