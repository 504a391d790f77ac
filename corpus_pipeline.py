"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir). ``run`` writes each stage's result as Parquet in the shared
folder and reads it again as the next stage's documents; what the stage itself wrote on the way is deleted
then. The last stage's tables stay until the session ends, as its result still reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatelight.llm import linededup, minhash, packing, scratch, suffix, toxicity
from gatelight.llm.tables import read


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier chain rejects."""
    return toxicity.reject(spark, docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines, all but their first occurrence."""
    return linededup.dedup(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return minhash.keep_one(spark, docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages."""
    return suffix.decontaminate(spark, docs, read(spark, sf_dir, "benchmark"))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what stays into bins."""
    return packing.pack(spark, docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near), ("decontamination", leaks), ("packing", bins)]

#: A trained classifier and best-fit can't be put in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
