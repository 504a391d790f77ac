"""Text depth: words, density and thin-content risk, by page and by site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text
from ..functions.exact import exact_text


def measured(rows: DataFrame, body: Column, content: Column, least: int) -> DataFrame:
    """Adds the depth measures of a text to rows. ``body`` is what it was taken from."""
    rows = rows.withColumn("_text", content)
    rows = rows.withColumns({"word_count": text.word_count(F.col("_text")), "_kb": text.kilobytes(body)})
    return rows.withColumns({
        "text_density": F.round(text.density(F.col("word_count"), F.col("_kb")), 2), "content_length_kb": F.round(F.col("_kb"), 2),
        "risk": text.risk(F.col("word_count"), least), "sample_text": text.sample(F.col("_text")),
    })


def page_depth(fetches: DataFrame, least: int = text.MIN_WORDS, exact: bool = False) -> DataFrame:
    """site, seq, url and the depth record. Failed fetches and statuses from 400 on are ERROR rows."""
    body = F.coalesce("body", F.lit(""))
    good = F.col("error").isNull() & (F.coalesce("status", F.lit(599)) < 400)
    content = exact_text("depth")(body) if exact else html.depth_text(body)
    out = measured(fetches.where("method = 'GET'").withColumn("_good", good), body, content, least)
    empty = {"word_count": "int", "text_density": "double", "content_length_kb": "double", "sample_text": "string"}
    kept = [F.when(F.col("_good"), F.col(c)).cast(t).alias(c) for c, t in empty.items()]
    risk = F.when(F.col("_good"), F.col("risk")).otherwise("ERROR").alias("risk")
    why = F.when(~F.col("_good"), F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status").cast("string")))).alias("error")
    return out.select("site", "seq", F.col("requested_url").alias("url"), "status", *kept, risk, why)


def summary(depth: DataFrame, *by: str) -> DataFrame:
    """Counts by risk. OK is whatever isn't thin or borderline, failed pages included."""
    thin, edge = F.count_if(F.col("risk") == "THIN"), F.count_if(F.col("risk") == "BORDERLINE")
    return depth.groupBy(*by).agg(F.count("*").alias("total"), thin.alias("thin"), edge.alias("borderline"), (F.count("*") - thin - edge).alias("ok"), (thin + edge).alias("at_risk"))


def lines(depth: DataFrame) -> DataFrame:
    """One console line a page."""
    mark = F.when(F.col("risk").isin("THIN", "BORDERLINE"), "⚠️ ").otherwise("✓ ")
    return depth.select("site", "seq", F.format_string("%s %-12s | %5d words | %s", mark, "risk", F.coalesce("word_count", F.lit(0)), F.substring("url", 1, 70)).alias("line"))


def report(depth: DataFrame, least: int = text.MIN_WORDS) -> DataFrame:
    """A text report a site."""
    head = F.concat(F.lit(f"Text depth\nMinimum words: {least}\nPages: "), F.count("*").cast("string"), F.lit("\n\n"))
    one = F.concat(F.col("url"), F.lit("\n  Status: "), F.coalesce(F.col("status").cast("string"), F.lit("error")), F.lit("\n  Words: "), F.coalesce(F.col("word_count").cast("string"), F.lit("None")), F.lit(", words/KB: "), F.coalesce(F.col("text_density").cast("string"), F.lit("None")), F.lit("\n  Risk: "), F.col("risk"), F.coalesce(F.concat(F.lit("\n  Error: "), F.col("error")), F.lit("")), F.lit("\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("x")))), lambda r: r["x"]), "\n")
    return depth.groupBy("site").agg(F.concat(head, body).alias("report"))
