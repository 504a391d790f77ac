"""Repeated audits as a stream: fetches come in, late and repeated rows are dealt with, counts go out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import html, text
from ..sources.fetches import FETCHES


def incoming(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files with fetches and the time that each was fetched at."""
    return spark.readStream.schema(FETCHES + ", fetched_at timestamp").parquet(path)


def health(fetches: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """By site and window: fetches, failures, thin pages and the mean time, each fetch counted once."""
    once = fetches.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["site", "requested_url", "method", "fetched_at"])
    words = text.word_count(html.depth_text(F.coalesce("body", F.lit(""))))
    failed = F.col("error").isNotNull() | (F.col("status") >= 400)
    return once.groupBy(F.window("fetched_at", window), "site").agg(F.count("*").alias("fetches"), F.count_if(failed).alias("failures"), F.count_if(~failed & (words < text.MIN_WORDS)).alias("thin"), F.round(F.avg("elapsed_ms"), 2).alias("mean_ms"))


def watch(fetches: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None], **options) -> StreamingQuery:
    """Run an audit function on each batch of new fetches."""
    return fetches.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True, **options).start()
