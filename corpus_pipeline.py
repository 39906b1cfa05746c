"""From raw documents to batches for training: quality rules, line dedup, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselattice.llm.common import documents, written
from caselattice.llm.line_dedup import line_dedup
from caselattice.llm.mixing import mixed
from caselattice.llm.ngram_join import one_of_each
from caselattice.llm.packing import packed
from caselattice.llm.quality_rules import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that fail the base rules, a rule that their host is held to, or whose host is rejected.

    Null and empty texts fail; null sources are one host; repeated rows are judged alike; very long texts are measured whole.
    """
    return quality_rules(docs).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines of 40 characters or more that 5 or more documents hold, but for the largest doc_id; n_chars follows the text.

    All documents stay. Null texts become empty; rows without a doc_id rank below all others; rows of one doc_id are one document.
    """
    return line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more on five-word shingles, the smallest doc_id; of repeated rows one.

    Rows without a doc_id, and texts that are empty after the line dedup, are linked with nothing and stay.
    """
    return one_of_each(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents taken more than once are repeated. Null sources are one; texts without words count 0."""
    return mixed(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its length bucket, batch and slot. Texts without words share a bucket of length 0; columns named like the added ones are replaced."""
    return packed(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Random rounding and the optimal buckets have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. Empty tables give an empty result."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
