"""The corpus pipeline: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, folder) and returns documents; the last one returns their pieces packed into
sequences. Between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyglass.llm import decontaminate, linedup, packing, quality, simhash
from tallyglass.llm.common import table
from tallyglass.plans.staging import stage


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier, learned from the folder's labels, doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, folder, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the multi-line chunks that occur before them."""
    return linedup.remove_repeated(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, folder, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Learned scores and token ids have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, folder, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
