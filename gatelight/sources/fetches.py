"""Where pages come from: snapshots, crawl files, URL lists, and a live fetcher as a Spark data source.

``fetches`` is the one fact table; every check is a function of it, so nothing is fetched twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import authority

FETCHES = (
    "site string, requested_url string, final_url string, method string, status int, body string, headers map<string,string>, "
    "redirect_count int, elapsed_ms double, ssl_error boolean, error_kind string, error string, seq long"
)
_RECORD = "url string, status string, title string, meta_description string, h1 string, content_length int, depth int, error string"
CRAWL_FILE = f"crawl_date string, start_url string, total_urls int, results array<struct<{', '.join(c.replace(' ', ': ', 1) for c in _RECORD.split(', '))}>>"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A stored fetches table."""
    return spark.read.schema(FETCHES).parquet(path)


def from_pages(pages: DataFrame) -> DataFrame:
    """Pages without a fetch log: each counts as fetched with status 200, in page order."""
    site = authority(F.col("url"))
    own = pages.select(site.alias("site"), F.col("url").alias("requested_url"), F.col("url").alias("final_url"), F.lit("GET").alias("method"), F.lit(200).alias("status"), F.col("html").alias("body"), F.col("page_id").alias("seq"))
    rest = {"headers": "map<string,string>", "redirect_count": "int", "elapsed_ms": "double", "ssl_error": "boolean", "error_kind": "string", "error": "string"}
    return own.select("*", *[F.lit(None).cast(t).alias(c) for c, t in rest.items()])


def crawl_file(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Crawl documents, one a file or one a line: one row a record, with start_url. A status that is no number becomes null."""
    raw = spark.read.schema(CRAWL_FILE).json(path, multiLine=not lines)
    rows = raw.select("start_url", "crawl_date", F.posexplode("results").alias("seq", "r")).select("start_url", "crawl_date", "seq", "r.*")
    return rows.withColumn("status", F.expr("try_cast(status AS INT)"))


def crawled_urls(records: DataFrame) -> DataFrame:
    """What the later checks take from a crawl: the URLs that answered with 200."""
    return records.where("status = 200").select("start_url", "seq", "url")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file with one URL a line; blank lines and comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url != '' and not startswith(url, '#')")


def write_crawl(records: DataFrame, start_url: str | None, crawl_date: str, path: str) -> None:
    """One JSON document a site, in the form that ``crawl_file`` reads. Without a start URL, it is the site's homepage."""
    status = F.coalesce(F.col("status").cast("string"), F.lit("error")).alias("status")
    record = F.struct("seq", "url", status, "title", "meta_description", "h1", "content_length", "depth", "error")
    rows = F.transform(F.array_sort(F.collect_list(record)), lambda r: r.dropFields("seq"))
    whole = records.groupBy("site").agg(F.count("*").cast("int").alias("total_urls"), rows.alias("results"))
    start = F.lit(start_url) if start_url else F.concat(F.lit("https://"), "site", F.lit("/"))
    whole.select(F.lit(crawl_date).alias("crawl_date"), start.alias("start_url"), "total_urls", "results").write.mode("overwrite").json(path)
