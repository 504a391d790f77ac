"""Crawling a snapshot: breadth-first from start URLs over the links of stored pages, and page metadata.

A URL's requested form is what counts as seen; a record carries the final URL. URLs off the start's domain
are seen but give no record. Links are followed on any status, down to ``depth``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions.exact import exact_meta, resolved
from ..functions.urls import authority
from ..sources.shared import keep

DEPTH = 2


def metadata(body: Column) -> dict[str, Column]:
    """Title, description and h1 with stand-ins for what is missing."""
    return {"title": html.or_else(html.title(body), "[no title]"), "meta_description": html.or_else(html.description(body), "[none]"), "h1": html.or_else(html.h1(body), "[no h1]")}


def links(pages: DataFrame, key: str, body: Column) -> DataFrame:
    """key, pos, link for every link that leaves its page."""
    return pages.select(key, F.posexplode(html.links(body)).alias("pos", "link"))


def crawl(fetches: DataFrame, starts: DataFrame, depth: int = DEPTH, save: Callable[[DataFrame], DataFrame] | None = None, exact: bool = True) -> DataFrame:
    """site, seq, depth, url, status, metadata, content_length, error, for starts (site, url).

    Each level is one join of the frontier with the stored pages and one anti-join with what was seen.
    Every level but the last is kept by ``save`` (a written table by default), so a plan stays one level long.
    """
    save = save or keep
    stored = fetches.where("method = 'GET'").dropDuplicates(["requested_url"]).select("requested_url", "final_url", "status", "body", "error")
    base = starts.select("site", authority(F.col("url")).alias("domain"), "url").withColumns({"depth": F.lit(0), "rank": F.lit("")})
    frontier, seen, records = base, None, None
    for level in range(depth + 1):
        frontier = save(frontier)
        seen = frontier.select("site", "url") if seen is None else seen.unionByName(frontier.select("site", "url"))
        own = frontier.where(authority(F.col("url")) == F.col("domain"))
        got = own.join(stored, own.url == stored.requested_url)
        records = got if records is None else records.unionByName(got)
        if level == depth:
            break
        out = got.where("error is null").select("site", "domain", "rank", F.posexplode(html.links(F.col("body"))).alias("pos", "link"), F.coalesce("final_url", "url").alias("base"))
        out = out.select("site", "domain", F.concat("rank", F.format_string("/%06d", "pos")).alias("rank"), resolved("base", "link").alias("url"), F.lit(level + 1).alias("depth"))
        # the first to name a URL brings it into the queue
        first = out.where("url is not null").groupBy("site", "domain", "url").agg(F.min("rank").alias("rank"), F.min("depth").alias("depth"))
        frontier = first.join(seen, ["site", "url"], "left_anti").select("site", "domain", "url", "depth", "rank")
    good = F.col("error").isNull()
    meta = exact_meta("body")
    own = records.withColumn("_m", meta) if exact else records
    cols = {k: (html.or_else(F.col(f"_m.{'description' if k == 'meta_description' else k}"), stand) if exact else metadata(F.col("body"))[k]) for k, stand in (("title", "[no title]"), ("meta_description", "[none]"), ("h1", "[no h1]"))}
    return own.select("site", "depth", "rank", F.when(good, F.coalesce("final_url", "url")).otherwise(F.col("url")).alias("url"), F.when(good, F.col("status")).alias("status"), *[F.when(good, c).alias(k) for k, c in cols.items()], F.when(good, F.length("body")).alias("content_length"), "error")


def lines(records: DataFrame) -> DataFrame:
    """One console line a record: status, the URL to 70 characters, the title to 60."""
    status = F.lpad(F.coalesce(F.col("status").cast("string"), F.lit("error")), 5, " ")
    title = F.substring(F.coalesce("title", F.lit("[no title]")), 1, 60)
    return records.select("site", "url", F.concat(status, F.lit(" | "), F.rpad(F.substring("url", 1, 70), 70, " "), F.lit(" | "), title).alias("line"))
