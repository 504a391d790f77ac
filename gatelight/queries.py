"""The audit's operators as queries over the stored tables, and over samples where those have no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html, text, urls
from .operators import completeness, crawl, depth, duplicates, metrics, policy, rubric, tasks, technical
from .plans import modes, registry, samples
from .sources.fetches import from_pages, read_table
from .sources.shared import keep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _joined(items: Column, by: str = "; ") -> Column:
    return F.array_join(items, by)


# text depth


@query
def text_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = depth.measured(read_table(spark, sf_dir, "pages"), F.col("html"), html.depth_text(F.col("html")), text.MIN_WORDS)
    return own.select("page_id", "url", "word_count", "text_density", "content_length_kb", "risk", "sample_text")


@query
def depth_summary_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.summary(depth.page_depth(from_pages(read_table(spark, sf_dir, "pages"))), "site")


@query
def depth_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = depth.measured(read_table(spark, sf_dir, "documents"), F.col("text"), F.col("text"), text.MIN_WORDS)
    return own.select("doc_id", "word_count", "text_density", "content_length_kb", "risk", "sample_text")


@query
def depth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.lines(depth.page_depth(from_pages(read_table(spark, sf_dir, "pages"))))


@query
def depth_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.report(depth.page_depth(from_pages(read_table(spark, sf_dir, "pages"))))


@query
def word_band_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_table(spark, sf_dir, "documents").select("lang", text.word_count(F.col("text")).alias("words"))
    by = own.withColumn("risk", text.risk(F.col("words"))).rollup("lang", "risk").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    return by.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), F.coalesce("risk", F.lit("ALL")).alias("risk"), "n", "words")


@query
def guide_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.guides(depth.page_depth(from_pages(read_table(spark, sf_dir, "pages"))))


# metadata, links, URLs


@query
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("html")
    return read_table(spark, sf_dir, "pages").select("page_id", *[c.alias(k) for k, c in crawl.metadata(body).items()], F.length(body).alias("content_length"))


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.links(read_table(spark, sf_dir, "pages"), "page_id", F.col("html"))


@query
def same_domain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").withColumn("site", urls.authority(F.col("url")))
    found = pages.select("page_id", "site", F.explode(html.links(F.col("html"))).alias("link"))
    inner = (F.startswith("link", F.lit("/")) & ~F.startswith("link", F.lit("//"))) | (urls.authority(F.col("link")) == F.col("site"))
    return found.groupBy("page_id", "site").agg(F.count("*").alias("links"), F.count_if(inner).alias("same_domain"))


@query
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read_table(spark, sf_dir, "pages").select("page_id", urls.authority(u).alias("authority"), urls.origin(u).alias("origin"), urls.path(u).alias("path"), urls.is_https(u).alias("https"), urls.session_like(u).alias("session_like"))


@query
def https_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    secure = urls.is_https(F.col("url"))
    pages = read_table(spark, sf_dir, "pages").select(urls.authority(F.col("url")).alias("site"), secure.alias("secure"))
    return pages.groupBy("site").agg(F.count("*").alias("pages"), F.count_if("secure").alias("secure_pages"), F.when(F.bool_and("secure"), "OK").otherwise("WARNING").alias("status"))


@query
def repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_table(spark, sf_dir, "pages").select(urls.authority(F.col("url")).alias("site"), html.title(F.col("html")).alias("title"))
    return own.groupBy("site", "title").agg(F.count("*").alias("pages")).where("pages > 1")


# phrases and identity


@query
def placeholder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts hold each phrase, those that none holds included."""
    docs = read_table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "text")
    pages = read_table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), html.body_text(F.col("html")).alias("text"))
    found = text.found_phrases(F.col("text"), text.PLACEHOLDERS)
    by = docs.unionByName(pages).select("source", found.alias("found")).groupBy("source").agg(*[F.count_if(F.array_contains("found", p)).alias(f"n{k}") for k, p in enumerate(text.PLACEHOLDERS)])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"n{k}").alias("n")) for k, p in enumerate(text.PLACEHOLDERS)]))
    return by.select("source", each.alias("r")).select("source", "r.*")


@query
def identity_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    own = read_table(spark, sf_dir, "documents").select("doc_id", text.has_name(t).alias("has_name"), text.any_phrase(t, text.CONTACT).alias("has_contact"), text.any_phrase(t, text.CREDENTIALS).alias("has_credentials"), text.has_email(t).alias("has_email"))
    return own


# duplicates


def _pages_corpus(spark: SparkSession, sf_dir: str, scope: str = "site") -> DataFrame:
    return keep(duplicates.corpus(from_pages(read_table(spark, sf_dir, "pages")), scope=scope))


@query
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("first_id", "copies")


@query
def dup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = from_pages(read_table(spark, sf_dir, "pages"))
    return duplicates.candidates(duplicates.corpus(fetched, exact=False).drop("text")).select("site", "i", "j")


@query
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored pages against one another, whatever their sites."""
    return duplicates.similar_pairs(_pages_corpus(spark, sf_dir, scope=""))


@query
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _pages_corpus(spark, sf_dir, scope="")
    return duplicates.groups(own, duplicates.similar_pairs(own))


@query
def duplicate_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _pages_corpus(spark, sf_dir)
    return duplicates.risk(own, duplicates.groups(own, duplicates.similar_pairs(own)))


def _sample_groups(spark: SparkSession) -> DataFrame:
    own = F.transform(F.array_sort(F.collect_list(F.struct("member", "url", "sim"))), lambda r: F.struct(r["url"].alias("url"), r["sim"].alias("sim")))
    return samples.sample(spark, "alike").groupBy("site", "leader", "source").agg(own.alias("similar_pages"), F.avg("sim").alias("avg_similarity"))


@query
def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.lines(samples.sample(spark, "corpus"), _sample_groups(spark))


@query
def duplicate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.report(samples.sample(spark, "corpus"), _sample_groups(spark))


@query
def repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a site's stored pages share, and what a rubric makes of it."""
    shared = duplicates.repeated_share(duplicates.corpus(from_pages(read_table(spark, sf_dir, "pages")), exact=False))
    return shared.withColumn("verdict", rubric.boilerplate(F.col("shared_text")))


@query
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.shingle_overlap(read_table(spark, sf_dir, "documents"), "doc_id", read_table(spark, sf_dir, "benchmark"), "item_id")


# technical checks, completeness, gates


def _shown(found: DataFrame) -> DataFrame:
    return found.select("site", "check", "status", _joined(F.col("issues")).alias("issues"))


def _one(name: str, check: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(technical.checks(samples.fetches(spark)).where(F.col("check") == check))

    run.__name__ = name
    query(run)


for _name, _check in (("robots_check", "robots.txt"), ("sitemap_check", "sitemap.xml"), ("headers_check", "security_headers"), ("redirect_check", "redirects"), ("uptime_check", "dns_and_uptime"), ("tls_check", "https")):
    _one(_name, _check)


@query
def technical_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks with their details, in order."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return technical.checks(samples.fetches(spark)).select("site", "pos", "check", text.symbol(F.col("status")).alias("symbol"), "status", _joined(F.col("issues")).alias("issues"), text.clipped(shown, 240).alias("details"))


@query
def technical_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.summary(technical.checks(samples.fetches(spark)))


@query
def technical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.lines(technical.checks(samples.fetches(spark)))


@query
def technical_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.report(technical.checks(samples.fetches(spark)), "Technical checks")


@query
def completeness_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.lines(completeness.checks(samples.fetches(spark)), 25)


@query
def completeness_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.report(completeness.checks(samples.fetches(spark)), "Completeness checks")


@query
def completeness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(completeness.checks(samples.fetches(spark)).where("check = 'site_completeness'"))


@query
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(completeness.checks(samples.fetches(spark)).where("check = 'publisher_identity'"))


@query
def completeness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.summary(completeness.checks(samples.fetches(spark)))


@query
def preflight_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = samples.fetches(spark)
    return completeness.gates(completeness.checks(fetched), completeness.guides(depth.page_depth(fetched)))


@query
def site_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit of all stored pages: one verdict a site and requirement."""
    return modes.audit(spark, from_pages(read_table(spark, sf_dir, "pages")))["checklist"].select("site", "id", "severity", "verdict", "evidence")


def _findings(fetched: DataFrame) -> DataFrame:
    return policy.computed_findings(**modes.evidence(fetched, duplication=False)).drop("severity")


@query
def site_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit of the stored pages goes by, but for duplicates, which ``duplicate_risk`` has."""
    return _findings(from_pages(read_table(spark, sf_dir, "pages")))


@query
def sample_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of fetches with statuses, headers and the paths that the checks look at."""
    return _findings(samples.fetches(spark))


# registry, checklist, decision


@query
def requirement_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.requirements(spark)


@query
def rubric_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.rubrics(spark)


@query
def site_type_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    types, checks = registry.site_types(spark), registry.rubrics(spark)
    return types.join(F.broadcast(checks.groupBy("rubric").agg(F.count("*").alias("checks"))), "rubric", "left").select("site_type", "rubric", F.coalesce("checks", F.lit(0)).alias("checks"))


@query
def rubric_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requirements that each rubric check bears on."""
    checks = registry.rubrics(spark).select("check_id", "asks")
    own = registry.bears(spark).join(F.broadcast(checks), "check_id", "left")
    return own.join(F.broadcast(registry.requirements(spark).select("id", "severity")), "id").select("rubric", "id", "severity", "check_id", "asks")


@query
def rubric_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubric.requirement_findings(samples.sample(spark, "ratings"), registry.bears(spark))


@query
def rejection_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.priors(spark)


@query
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = registry.requirements(spark).rollup("section", "severity").agg(F.count("*").alias("n"))
    return by.select(F.coalesce("section", F.lit("ALL")).alias("section"), F.coalesce("severity", F.lit("ALL")).alias("severity"), "n")


def _report(spark: SparkSession) -> DataFrame:
    found = samples.sample(spark, "findings")
    return policy.checklist(found, registry.requirements(spark), found)


@query
def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark)


@query
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = samples.sample(spark, "findings")
    return policy.coverage(registry.requirements(spark), found)


@query
def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.decision(_report(spark))


@query
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _report(spark)
    return policy.markdown(report, policy.decision(report), policy.coverage(registry.requirements(spark), report))


@query
def rejection_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.rejection_ids(samples.sample(spark, "messages"), registry.rejections(spark))


@query
def audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.diff(samples.sample(spark, "before"), samples.sample(spark, "after"))


# tasks, rubrics, metrics, crawling


def _work(spark: SparkSession) -> DataFrame:
    own = samples.sample(spark, "work").withColumns({"files": F.split("file_list", " "), "steps": F.array(F.concat(F.lit("do: "), "title")), "criteria": F.array(F.concat("id", F.lit(" passes")))})
    return tasks.tasks(own)


@query
def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _work(spark).select("site", "rank", "seq", "id", "severity", "priority", "title", "evidence", "effort_hours")


@query
def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.summary(_work(spark))


@query
def task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.todo_lines(_work(spark))


@query
def task_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.issue_texts(_work(spark))


@query
def rubric_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubric.page_checks(read_table(spark, sf_dir, "pages"))


@query
def rubric_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubric.rated(samples.sample(spark, "ratings"))


@query
def accuracy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well thinness foretells a poor quality label."""
    thin = read_table(spark, sf_dir, "documents").select("doc_id", (text.risk(text.word_count(F.col("text"))) == "THIN").alias("flagged"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("rejected"))
    return metrics.accuracy(thin.join(labels, "doc_id"))


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a page each, linked in a ring with shortcuts, crawled from two of them two levels deep."""
    nation = read_table(spark, sf_dir, "nation")
    size = nation.count()
    url = lambda k: F.concat(F.lit("https://n.example/"), k.cast("string"))
    k = F.col("n_nationkey")
    body = F.concat(F.lit('<title>Page '), k.cast("string"), F.lit('</title><a href="'), url((k + 1) % size), F.lit('"></a><a href="'), url((k * 3) % size), F.lit('"></a><a href="#x"></a><a href="https://off.example/"></a>'))
    pages = nation.select(k.cast("long").alias("page_id"), url(k).alias("url"), body.alias("html"))
    starts = spark.createDataFrame([("n.example", "https://n.example/0"), ("n.example", "https://n.example/2")], "site string, url string")
    return crawl.crawl(from_pages(pages), starts, 2)


@query
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir).groupBy("url").agg(F.min("depth").alias("depth"))


@query
def crawl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.lines(_crawled(spark, sf_dir))
