"""The corpus pipeline: quality classifier, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents, whatever their names, with their values.

In every stage rows with a NULL doc_id are judged by their text or stay, rows that repeat share their fate or, being one
document, are not compared with each other, equal texts tie for the smallest doc_id, long texts are read whole, and an
empty table gives an empty result; the operators' docstrings say more. Without labels all texts are good, without
benchmark items none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, line_dedup, near_dedup, packing, quality
from lexloom.llm._common import discard, materialize, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good; NULL and empty texts go."""
    return quality.keep_good(spark, docs, read(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier document has; one of which nothing is left goes."""
    return line_dedup.dedup_lines(spark, docs, count=None)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id."""
    return near_dedup.drop_near_duplicates(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(spark, docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows of what is left, with their text; texts without a token are in none."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL expresses none of the trained classifier, the alignment and the sequential packing; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written as Parquet and read again, and that of the
    stage before is deleted then. The result's columns are those of ``packing.pack``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(spark, stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
