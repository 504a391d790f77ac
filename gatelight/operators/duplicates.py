"""Near-duplicate pages: the ratio of matching blocks, leader groups, and what they amount to.

The ratio depends on the order of its arguments, so pairs are (earlier, later) by ``seq``. Candidates come
from a bound that loses none: with ratio >= t the shorter text has at least t / (2 - t) of the longer
one's length. A second bound, in ``matching``, counts the runs of characters that two texts have in common.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html
from ..functions.exact import exact_text, packed, unpacked
from ..functions.matching import Texts
from ..functions.text import percent
from ..sources.shared import keep

THRESHOLD = 0.8
#: At a site's share of groups above this, duplication counts as high.
HIGH = 0.3
_Save = Callable[[DataFrame], DataFrame]


def corpus(fetches: DataFrame, profile: str = "dup", exact: bool = True, scope: str = "site") -> DataFrame:
    """site, seq, url, text, n: the pages with text, each URL once. Profile ``dup`` or ``dup_compat``."""
    good = fetches.where("method = 'GET' and error is null and status < 400")
    content = exact_text(profile)("body") if exact else html.dup_text(F.col("body"))
    site = F.col("site") if scope == "site" else F.lit("")
    first = good.groupBy(site.alias("site"), F.col("requested_url").alias("url")).agg(F.min("seq").alias("seq"), F.min_by("body", "seq").alias("body"))
    return first.select("site", "seq", "url", content.alias("text")).where("text != ''").withColumn("n", F.length("text"))


def candidates(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """site, i, j: the pairs that the length bound lets through, i before j."""
    factor = (2 - threshold) / threshold
    band = F.floor(F.log("n") / math.log(factor) + 1e-9)
    own = pages.select("site", "seq", "n", band.alias("band"))
    left = own.select("site", F.col("seq").alias("i"), F.col("n").alias("ni"), F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"))
    right = own.select("site", F.col("seq").alias("j"), F.col("n").alias("nj"), "band")
    both = left.join(right, ["site", "band"])
    bound = 2 * F.least("ni", "nj") / (F.col("ni") + F.col("nj"))
    return both.where((F.col("i") < F.col("j")) & (bound >= threshold)).select("site", "i", "j", "ni", "nj")


#: Characters of the texts that a task holds an index of, at most (a longer text is alone in its chunk), and where there are fewer texts,
#: how many chunks they are cut into; so many chunks are held against it in one task.
CHUNK, CHUNKS, ABREAST = 12_000_000, 24, 6


def _chunks(pages: DataFrame) -> DataFrame:
    """site, seq, n, chunk: a site's pages by length, cut into chunks of bounded size. Only counts by length are put in order."""
    by = pages.groupBy("site", "n").agg((F.count("*") * F.col("n")).cast("double").alias("chars"))
    size = by.agg(F.greatest(F.least(F.sum("chars") / CHUNKS, F.lit(float(CHUNK))), F.lit(1.0)).alias("size"))
    start = F.coalesce(F.sum("chars").over(Window.partitionBy("site").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = by.select("site", "n", "chars", start.alias("start")).crossJoin(F.broadcast(size))
    share = F.pmod(F.xxhash64("seq"), F.lit(1 << 20)) / (1 << 20)
    return pages.select("site", "seq", "n").join(placed, ["site", "n"]).select("site", "seq", "n", F.floor((F.col("start") + share * F.col("chars")) / F.col("size")).alias("chunk"))


def similar_pairs(pages: DataFrame, threshold: float = THRESHOLD, save: _Save | None = None) -> DataFrame:
    """site, i, j, sim for all pairs i < j with ratio >= threshold.

    A site's pages are cut into chunks by length. Each chunk is held against itself and the chunks of longer
    texts that the length bound lets through, some at a time; within a task, ``matching`` finds the pairs by the
    runs of characters that they have in common, so that no text is moved for a single pair.
    """
    save = save or keep
    own = save(_chunks(pages))
    each = own.groupBy("site", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    near = F.col("hi") >= F.col("lo") * (threshold / (2 - threshold)) * (1 - 1e-9)
    both = each.select("site", F.col("chunk").alias("held"), "hi").join(each.select("site", "chunk", "lo"), "site").where((F.col("held") <= F.col("chunk")) & near)
    part = lambda c: F.floor(F.col(c) / ABREAST)
    units = both.select("site", "held", "chunk", part("chunk").alias("part"))
    asks = own.join(units.where("held < chunk"), ["site", "chunk"]).select("site", "seq", "held", "part", F.lit(False).alias("index"), F.lit(False).alias("inner"))
    holds = own.withColumnRenamed("chunk", "held").join(units.select("site", "held", "part").distinct(), ["site", "held"]).select("site", "seq", "held", "part", F.lit(True).alias("index"), (part("held") == F.col("part")).alias("inner"))
    rows = asks.union(holds).join(pages.select("site", "seq", packed("text").alias("text")), ["site", "seq"])

    def found(unit: pa.Table) -> pa.Table:
        index, asked = unit.filter(unit["index"]), unit.filter(pc.invert(unit["index"]))
        texts = Texts(index["seq"].to_pylist(), [unpacked(x) for x in index["text"].to_pylist()])
        pairs = list(texts.within(threshold)) if index["inner"][0].as_py() else []
        for batch in asked.to_batches(256):
            for seq, text in zip(batch["seq"].to_pylist(), batch["text"].to_pylist()):
                pairs += texts.similar(seq, unpacked(text), threshold)
        i, j, sim = zip(*pairs) if pairs else ((), (), ())
        site = pa.repeat(unit["site"][0], len(pairs))
        return pa.table([site, pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(sim, pa.float64())], ["site", "i", "j", "sim"])

    tasks = 8 * pages.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, "site", "held", "part").groupBy("site", "held", "part").applyInArrow(found, "site string, i long, j long, sim double")


def leaders(pages: DataFrame, edges: DataFrame, save: _Save | None = None) -> DataFrame:
    """site, member, leader for every page that an earlier leader is similar to.

    In order, a page leads unless an earlier leader is similar to it, and a member joins the first such. By
    rounds: a page is a member once one earlier neighbour leads, and leads once all of them are members.
    """
    save = save or keep
    edges = save(edges.select("site", "i", "j"))
    state = save(edges.select("site", F.col("i").alias("v")).union(edges.select("site", "j")).distinct().withColumn("leads", F.lit(None).cast("boolean")))
    while True:
        of = state.select("site", F.col("v").alias("i"), F.col("leads").alias("led"))
        seen = edges.join(of, ["site", "i"]).groupBy("site", F.col("j").alias("v")).agg(F.coalesce(F.bool_or("led"), F.lit(False)).alias("under"), F.count_if(F.col("led").isNull() | F.col("led")).alias("open"))
        new = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("under").isNull() | (~F.col("under") & (F.col("open") == 0)), F.lit(True)).when(F.col("under"), F.lit(False))
        state = save(state.join(seen, ["site", "v"], "left").select("site", "v", new.alias("leads")))
        if state.where("leads is null").isEmpty():
            break
    lead = state.where("leads").select("site", F.col("v").alias("i"))
    follow = state.where("not leads").select("site", F.col("v").alias("j"))
    return edges.join(lead, ["site", "i"]).join(follow, ["site", "j"]).groupBy("site", F.col("j").alias("member")).agg(F.min("i").alias("leader"))


def groups(pages: DataFrame, pairs: DataFrame, save: _Save | None = None) -> DataFrame:
    """site, source, similar_pages (url, sim in page order), avg_similarity for each leader with members."""
    save = save or keep
    pairs = save(pairs)
    found = leaders(pages, pairs, save).join(pairs.select("site", F.col("i").alias("leader"), F.col("j").alias("member"), "sim"), ["site", "leader", "member"])
    url = pages.select("site", "seq", "url")
    named = found.join(url.select("site", F.col("seq").alias("member"), F.col("url").alias("member_url")), ["site", "member"]).join(url.select("site", F.col("seq").alias("leader"), F.col("url").alias("source")), ["site", "leader"])
    own = F.transform(F.array_sort(F.collect_list(F.struct("member", "member_url", "sim"))), lambda r: F.struct(r["member_url"].alias("url"), r["sim"].alias("sim")))
    return named.groupBy("site", "leader", "source").agg(own.alias("similar_pages"), F.avg("sim").alias("avg_similarity"))


def risk(pages: DataFrame, found: DataFrame) -> DataFrame:
    """site, pages, groups, affected pages, their share, and whether duplication is high."""
    total = pages.groupBy("site").agg(F.count("*").alias("pages"))
    n = found.groupBy("site").agg(F.count("*").alias("groups"), F.sum(F.size("similar_pages") + 1).alias("affected"))
    out = total.join(n, "site", "left").na.fill(0, ["groups", "affected"])
    return out.withColumns({"affected_share": F.round(F.col("affected") / F.col("pages"), 4), "duplication": F.when(F.col("groups") > F.col("pages") * HIGH, "high").otherwise("acceptable")})


def lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Console lines a site, in order: each group's source and its similar pages, then the risk. URLs are cut at 70 and 60."""
    total = pages.groupBy("site").agg(F.count("*").alias("pages"))
    similar = F.transform("similar_pages", lambda r: F.concat(F.lit("  ↔ "), percent(r["sim"]), F.lit(" | "), F.substring(r["url"], 1, 60)))
    block = F.concat(F.lit("source "), F.substring("source", 1, 70), F.lit("\n"), F.array_join(similar, "\n"))
    by = found.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leader", block.alias("x")))), lambda r: r["x"]), "\n").alias("blocks"), F.count("*").alias("groups"))
    own = total.join(by, "site", "left").na.fill(0, ["groups"])
    high = F.col("groups") > F.col("pages") * HIGH
    last = F.when(high, F.format_string("⚠️  duplication is high: %d groups on %d pages", "groups", "pages")).otherwise(F.format_string("✓ duplication is acceptable: %d groups on %d pages", "groups", "pages"))
    return own.select("site", F.concat(F.coalesce(F.concat("blocks", F.lit("\n")), F.lit("✓ no similar pages\n")), last).alias("lines"))


def report(pages: DataFrame, found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A text report a site with full URLs."""
    total = pages.groupBy("site").agg(F.count("*").alias("pages"))
    similar = F.transform("similar_pages", lambda r: F.concat(F.lit("  "), percent(r["sim"]), F.lit(" | "), r["url"]))
    block = F.concat(F.lit("Source: "), "source", F.lit("\nMean: "), percent(F.col("avg_similarity")), F.lit("\n"), F.array_join(similar, "\n"), F.lit("\n"))
    by = found.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leader", block.alias("x")))), lambda r: r["x"]), "\n").alias("blocks"), F.count("*").alias("groups"))
    head = F.format_string(f"Similar pages\nThreshold: {threshold}\nPages: %d\nGroups: %d\n\n", "pages", "groups")
    return total.join(by, "site", "left").na.fill(0, ["groups"]).select("site", F.concat(head, F.coalesce("blocks", F.lit(""))).alias("report"))


def repeated_share(pages: DataFrame) -> DataFrame:
    """site, pages, and the mean share of a page's text in chunks (its lines) that other pages of the site have too."""
    own = pages.select("site", "seq", F.explode(F.split("text", "\n")).alias("chunk"))
    each = own.groupBy("site", "seq", "chunk").agg((F.length("chunk") * F.count("*")).alias("chars"))
    on = own.groupBy("site", "chunk").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).select("site", "chunk", (F.col("a") != F.col("b")).alias("shared"))
    page = each.join(on, ["site", "chunk"]).groupBy("site", "seq").agg((F.sum(F.when(F.col("shared"), F.col("chars")).otherwise(0)) / F.sum("chars")).alias("share"))
    return page.groupBy("site").agg(F.count("*").alias("pages"), F.round(F.avg("share"), 4).alias("shared_text"))


def shingle_overlap(docs: DataFrame, doc_key: str, others: DataFrame, other_key: str, words: int = 5) -> DataFrame:
    """For each text that shares any run of ``words`` words with one of ``others``: the largest share of its distinct
    runs that one other text holds, that text (the least key at ties), and the overlap band."""

    def runs(df: DataFrame, key: str, name: str) -> DataFrame:
        own = F.transform(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
        # within the lambda the words are split and hashed once; a column would be evaluated again for every run
        each = F.transform(F.array(own), lambda h: F.when(F.size(h) >= words, F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))))
        return df.select(F.col(key).alias(name), F.array_distinct(F.element_at(each, 1)).alias("runs")).where("runs is not null")

    a, b = runs(docs, doc_key, "doc"), runs(others, other_key, "other")
    left = a.select("doc", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    hits = left.join(b.select("other", F.explode("runs").alias("run")), "run").groupBy("doc", "other").agg(F.count("*").alias("common"), F.max("n").alias("n"))
    best = hits.groupBy("doc").agg(F.max("n").alias("n"), F.min(F.struct((-F.col("common")).alias("c"), F.col("other").alias("other"))).alias("best"))
    share = F.round(-F.col("best.c") / F.col("n"), 4)
    return best.select(F.col("doc").alias(doc_key), F.col("best.other").alias(other_key), share.alias("overlap"), overlap_band(share).alias("band"))


def overlap_band(share: Column) -> Column:
    return F.when(share < 0.4, "safe").when(share <= 0.6, "monitor").otherwise("high")
