"""The operators as queries over the whole tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fertility, linededup, minhash, ordinal, packing, rangecoder, sitetree, suffix, toxicity
from .tables import read


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(spark, read(spark, sf_dir, "pages"))


def op2_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangecoder.coded(spark, read(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(spark, read(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(spark, read(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, read(spark, sf_dir, "documents"))


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(spark, read(spark, sf_dir, "documents"), borrow=True)


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.scored(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.matches(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_site_style_tree, op2_range_coder, op3_chat_format, op4_toxicity, op5_line_dedup, op6_near_dedup, op7_fertility, op8_ordinal_quality, op9_decontamination, op10_packing)}
SQL: dict[str, str] = {"op5_line_dedup": linededup.SQL}
