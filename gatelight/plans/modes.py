"""The audit's modes, each one plan over a fetches table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions.urls import session_like
from ..operators import completeness, depth, duplicates, policy, tasks, technical
from ..sources.shared import keep
from . import registry


def site_sessions(fetches: DataFrame) -> DataFrame:
    """site, URLs, and those that name a session or a person."""
    return fetches.where("method = 'GET'").groupBy("site").agg(F.count("*").alias("urls"), F.count_if(session_like(F.col("requested_url"))).alias("keyed"))


def site_overlap(fetches: DataFrame, others: DataFrame) -> DataFrame:
    """site and the largest share of a page's word runs that one of ``others`` (id, text) holds; sites without any have 0."""
    good = fetches.where("method = 'GET' and error is null and status < 400")
    own = good.select("site", F.concat_ws(" ", F.col("seq").cast("string"), "requested_url").alias("page"), html.depth_text(F.coalesce("body", F.lit(""))).alias("text"))
    shares = duplicates.shingle_overlap(own, "page", others, "id").join(own.select("page", "site"), "page").groupBy("site").agg(F.max("overlap").alias("overlap"))
    return good.select("site").distinct().join(shares, "site", "left").na.fill(0.0, ["overlap"])


def evidence(fetches: DataFrame, others: DataFrame | None = None, duplication: bool = True) -> dict[str, DataFrame]:
    """All computed evidence of a snapshot. ``others`` (id, text) are the texts of competitors, if there are any.

    ``duplication`` is left out only where it is judged elsewhere: it is the one part that SQL can't say.
    """
    out = {
        "depth": depth.page_depth(fetches), "technical": technical.checks(fetches), "completeness": completeness.checks(fetches), "sellers": technical.seller_file(fetches),
        "trust_pages": technical.trust_pages(fetches), "trust": completeness.trust(fetches), "sessions": site_sessions(fetches),
    }
    if duplication:
        corpus = keep(duplicates.corpus(fetches))
        out["duplication"] = duplicates.risk(corpus, duplicates.groups(corpus, duplicates.similar_pairs(corpus)))
    if others is not None:
        out["overlap"] = site_overlap(fetches, others)
    return out


def audit(spark: SparkSession, fetches: DataFrame, manual: DataFrame | None = None, others: DataFrame | None = None) -> dict[str, DataFrame]:
    """Before an application: checklist, decision, coverage, gates. ``manual`` holds findings by hand."""
    own = evidence(fetches, others)
    found = policy.computed_findings(**own)
    found = found.unionByName(manual.select(*found.columns)) if manual is not None else found
    needs = registry.requirements(spark)
    report = policy.checklist(fetches.select("site"), needs, found)
    return {"checklist": report, "decision": policy.decision(report), "coverage": policy.coverage(needs, report), "gates": completeness.gates(own["completeness"], completeness.guides(own["depth"]))}


def repo_and_live(spark: SparkSession, repo: DataFrame, live: DataFrame) -> DataFrame:
    """What the audit of a site's source pages (a snapshot of the build) and that of the live site say otherwise."""
    before, after = (audit(spark, x)["checklist"] for x in (repo, live))
    return policy.diff(before, after).where("change != 'same'")


def after_rejection(spark: SparkSession, report: DataFrame, messages: DataFrame) -> DataFrame:
    """The checklist rows that a rejection message points at."""
    ids = policy.rejection_ids(messages, registry.rejections(spark))
    return ids.join(report, "id").select("site", "message_id", "theme", "id", "severity", "verdict", "evidence", "next_action")


def after_fix(before: DataFrame, after: DataFrame) -> DataFrame:
    return policy.diff(before, after)


def task_plan(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    planned = tasks.tasks(found)
    return planned, tasks.summary(planned)


def health_check(spark: SparkSession, fetches: DataFrame) -> DataFrame:
    """A line a site: technical failures and warnings with the depth counts."""
    return technical.summary(technical.checks(fetches)).join(depth.summary(depth.page_depth(fetches), "site"), "site", "left")
