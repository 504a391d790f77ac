"""Rubrics: what can be computed of a page, and a site's pass rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text, urls


def page_checks(pages: DataFrame) -> DataFrame:
    """page_id, check_id, passed for the rubric checks that a page shows by itself."""
    body, url = F.col("html"), F.col("url")
    base = urls.authority(url)
    inner = F.size(F.filter(html.links(body), lambda x: (F.startswith(x, F.lit("/")) & ~F.startswith(x, F.lit("//"))) | ((base != "") & (urls.authority(x) == base))))
    long = F.length(html.description(body)).between(100, 160)
    named = (F.length(html.title(body)) >= 10) & (F.length(html.h1(body)) >= 3)
    each = {"TOOL-02": text.word_count(html.depth_text(body)) >= text.MIN_WORDS, "TOOL-06": inner >= 1, "TOOL-11": ~urls.session_like(url), "TOOL-12": long, "TOOL-13": named, "QUIZ-09": text.word_count(html.depth_text(body)) >= 200, "QUIZ-15": html.has_canonical(body)}
    rows = F.array(*[F.struct(F.lit(k).alias("check_id"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in each.items()])
    return pages.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")


def rated(results: DataFrame, key: str = "site") -> DataFrame:
    """From (site, rubric, check_id, passed, overlap): the pass rate and the verdict.

    A tool site passes from 80 %, a quiz site from 70 % with an overlap under 40 %; under 50 % fails; what lies
    between is Unknown.
    """
    rate = F.avg(F.col("passed").cast("double"))
    own = results.groupBy(key, "rubric").agg(F.count("*").alias("checks"), F.round(rate, 4).alias("pass_rate"), F.max("overlap").alias("overlap"))
    good = F.when(F.col("rubric") == "quiz", (F.col("pass_rate") >= 0.7) & (F.coalesce("overlap", F.lit(0.0)) < 0.4)).otherwise(F.col("pass_rate") >= 0.8)
    return own.withColumn("verdict", F.when(good, "Pass").when(F.col("pass_rate") < 0.5, "Fail").otherwise("Unknown"))


def boilerplate(share: Column) -> Column:
    return F.when(share <= 0.3, "Pass").when(share >= 0.5, "Fail").otherwise("Unknown")


def site_checks(shared_text: DataFrame, overlap: DataFrame) -> DataFrame:
    """site, check_id, share, verdict: a quiz site's shared boilerplate and the overlap of its pages.

    From (site, shared_text), the share of text that pages have in common, and (site, overlap), the largest share that two have.
    """
    a = shared_text.select("site", F.lit("QUIZ-18").alias("check_id"), F.col("shared_text").alias("share"), boilerplate(F.col("shared_text")).alias("verdict"))
    b = overlap.select("site", F.lit("QUIZ-19").alias("check_id"), F.col("overlap").alias("share"), F.when(F.col("overlap") < 0.4, "Pass").otherwise("Fail").alias("verdict"))
    return a.unionByName(b)


def requirement_findings(results: DataFrame, bears: DataFrame) -> DataFrame:
    """site, id, verdict, evidence from (site, rubric, check_id, passed): each requirement by the checks that bear on it.

    One that failed fails it; all that were made and passed leave it Unknown until the manual ones are made too.
    """
    own = results.join(F.broadcast(bears.where("check_id is not null")), ["rubric", "check_id"])
    all_ = F.broadcast(bears.where("check_id is not null").groupBy("rubric", "id").agg(F.count("*").alias("checks")))
    by = own.groupBy("site", "rubric", "id").agg(F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("made")).join(all_, ["rubric", "id"])
    verdict = F.when(F.col("failed") > 0, "Fail").when(F.col("made") == F.col("checks"), "Pass").otherwise("Unknown")
    return by.select("site", "id", verdict.alias("verdict"), F.format_string("%d of %d checks made, %d failed", "made", "checks", "failed").alias("evidence"))
