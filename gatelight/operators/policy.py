"""From evidence to verdicts: the checklist, coverage, readiness, rejections, and comparison of audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent
from ..plans.registry import SEVERITY_RANK

#: Sections whose failures make the policy requirement itself fail.
_POLICY_SECTIONS = ("C", "D", "E", "F", "G", "H")


def rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), severity)


def checklist(sites: DataFrame, requirements: DataFrame, findings: DataFrame) -> DataFrame:
    """Every requirement once a site: severity, verdict, evidence, next_action.

    Of several findings the worst counts (Fail, Unknown, Pass, N/A). None is Unknown; so is a Pass without
    evidence, or an N/A without a reason. The finding's severity, if it has one, goes before the table's.
    """
    order = F.element_at(F.create_map(*[F.lit(x) for x in ("Fail", 1, "Unknown", 2, "Pass", 3, "N/A", 4)]), F.col("verdict"))
    worst = findings.groupBy("site", "id").agg(F.min(F.struct(order.alias("o"), "verdict", "severity", "evidence", "next_action")).alias("f"))
    own = sites.select("site").distinct().crossJoin(F.broadcast(requirements)).join(worst, ["site", "id"], "left")
    bare = F.coalesce(F.col("f.evidence"), F.lit("")) == ""
    verdict = F.when(F.col("f.verdict").isNull() | (F.col("f.verdict").isin("Pass", "N/A") & bare), "Unknown").otherwise(F.col("f.verdict"))
    out = own.select("site", "section", "id", F.coalesce("f.severity", "severity").alias("severity"), verdict.alias("verdict"), F.coalesce("f.evidence", F.lit("")).alias("evidence"), F.coalesce("f.next_action", F.lit("")).alias("next_action"))
    # the requirement that stands for all content policies follows them
    broken = out.where(F.col("section").isin(*_POLICY_SECTIONS) & (F.col("verdict") == "Fail")).select("site").distinct().withColumn("broken", F.lit(True))
    derived = (F.col("id") == "ADS-ELIG-03") & F.coalesce("broken", F.lit(False))
    return out.join(broken, "site", "left").select("site", "section", "id", "severity", F.when(derived, "Fail").otherwise(F.col("verdict")).alias("verdict"), F.when(derived & (F.col("evidence") == ""), "a content policy fails").otherwise(F.col("evidence")).alias("evidence"), "next_action")


def coverage(requirements: DataFrame, report: DataFrame) -> DataFrame:
    """site, ids in the registry and in the report, and those that are missing."""
    n = requirements.count()
    every = report.select("site").distinct().crossJoin(F.broadcast(requirements.select("id")))
    missing = every.join(report.select("site", "id"), ["site", "id"], "left_anti").groupBy("site").agg(F.array_sort(F.collect_list("id")).alias("missing"))
    counts = report.join(F.broadcast(requirements.select("id")), "id", "left_semi").groupBy("site").agg(F.count_distinct("id").alias("in_report"))
    return counts.join(missing, "site", "left").select("site", F.lit(n).cast("long").alias("in_reference"), "in_report", F.coalesce(F.array_join("missing", ", "), F.lit("none")).alias("missing"))


def decision(report: DataFrame) -> DataFrame:
    """site, fails by severity, open blockers and the decision."""
    def fails(severity: str) -> Column:
        return F.count_if((F.col("severity") == severity) & (F.col("verdict") == "Fail"))

    unknown = F.count_if((F.col("severity") == "Blocker") & (F.col("verdict") == "Unknown"))
    out = report.groupBy("site").agg(fails("Blocker").alias("blocker_fails"), fails("High").alias("high_fails"), fails("Medium").alias("medium_fails"), unknown.alias("blocker_unknowns"))
    ready = F.when(F.col("blocker_fails") > 0, "Not ready").when((F.col("high_fails") + F.col("medium_fails") + F.col("blocker_unknowns")) > 0, "Ready after fixes").otherwise("Ready")
    return out.withColumn("decision", ready)


_BLOCKED = "all crawlers are disallowed"
#: Requirement, check, what its statuses amount to (any other, and a check that wasn't made, is Unknown), what to do.
_CHECKS = (
    ("ADS-CRAWL-02", "robots.txt", {"OK": "Pass", "MISSING": "Pass", "FAIL": "Fail"}, "let the crawlers in"),
    ("ADS-CRAWL-04", "redirects", {"OK": "Pass", "WARNING": "Fail", "FAIL": "Fail"}, "shorten redirects"),
    ("ADS-CRAWL-06", "dns_and_uptime", {"OK": "Pass", "FAIL": "Fail"}, "mend hosting"),
    ("ADS-CRAWL-07", "sitemap.xml", {"OK": "Pass", "WARNING": "Fail", "MISSING": "Fail"}, "publish a sitemap"),
)


def computed_findings(
    depth: DataFrame | None = None, technical: DataFrame | None = None, completeness: DataFrame | None = None, duplication: DataFrame | None = None,
    sellers: DataFrame | None = None, trust_pages: DataFrame | None = None, trust: DataFrame | None = None, sessions: DataFrame | None = None, overlap: DataFrame | None = None,
) -> DataFrame:
    """Findings that the checks' results bear out, in the form that ``checklist`` takes.

    What wasn't fetched is Unknown, and so is what a check can't settle: a Pass or a Fail is only said of what was seen.
    """
    parts: list[DataFrame] = []

    def add(rows: DataFrame, id_: str, verdict: Column, evidence: Column, action: str) -> None:
        parts.append(rows.select("site", F.lit(id_).alias("id"), verdict.alias("verdict"), F.lit(None).cast("string").alias("severity"), evidence.alias("evidence"), F.when(verdict == "Fail", action).otherwise("").alias("next_action")))

    def judged(good: Column, known: Column | None = None) -> Column:
        """Pass or Fail; Unknown where good is null or known is false."""
        out = F.when(good, "Pass").when(~good, "Fail").otherwise("Unknown")
        return out if known is None else F.when(known, out).otherwise("Unknown")

    if depth is not None:
        by = depth.groupBy("site").agg(F.count_if(F.col("risk") == "THIN").alias("thin"), F.count("*").alias("n"), F.count_if(F.col("risk") == "ERROR").alias("errors"), F.count_if(F.col("word_count") == 0).alias("empty"), F.count_if(F.col("word_count") >= 1200).alias("guides"))
        by = by.withColumn("read", F.col("n") - F.col("errors"))
        seen = F.col("read") > 0
        add(by, "ADS-CONTENT-01", F.when(seen & (F.col("thin") == F.col("read")), "Fail").otherwise("Unknown"), F.format_string("%d of %d pages read are thin", "thin", "read"), "write useful pages")
        add(by, "ADS-CONTENT-03", judged(F.col("thin") == 0, seen), F.format_string("%d of %d pages read are thin", "thin", "read"), "extend the thin pages")
        add(by, "ADS-CONTENT-04", judged(F.col("empty") == 0, seen), F.format_string("%d of %d pages read are empty", "empty", "read"), "fill the empty pages")
        add(by, "ADS-CRAWL-01", judged(F.col("errors") == 0), F.format_string("%d of %d pages fail", "errors", "n"), "mend the failing pages")
        add(by, "ADS-COMPLETE-02", judged(F.col("guides") >= 3, seen), F.format_string("%d substantial guides", "guides"), "publish three guides")
    if technical is not None:
        for id_, check, means, action in _CHECKS:
            rows = technical.where(F.col("check") == check)
            verdict = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in means.items() for x in kv]), F.col("status")), F.lit("Unknown"))
            # a rule for the ads crawler overwrites the status of a rule for all, which counts nevertheless
            verdict = F.when((F.col("status") == "WARNING") & F.array_contains("issues", _BLOCKED), "Fail").otherwise(verdict)
            add(rows, id_, verdict, F.concat(F.lit(f"{check}: "), F.col("status")), action)
    if completeness is not None:
        named = F.concat("check", F.lit(": "), F.col("status"), F.when(F.size("issues") > 0, F.concat(F.lit("; "), F.array_join("issues", "; "))).otherwise(""))
        whole, who = (completeness.where(F.col("check") == c) for c in ("site_completeness", "publisher_identity"))
        # a homepage that doesn't answer says nothing of the pages behind it
        dead = F.exists("issues", lambda x: F.startswith(x, F.lit("homepage gives")))
        unread = F.exists(F.map_values("details"), lambda v: F.startswith(v, F.lit("ERROR")))
        state = F.when(dead | (unread & (F.col("status") == "OK")), "Unknown").when(F.col("status") == "OK", "Pass").when(F.col("status").isin("FAIL", "HIGH_RISK"), "Fail").otherwise("Unknown")
        add(whole, "ADS-COMPLETE-01", state, named, "finish the pages")
        add(whole, "ADS-CONTENT-04", state, named, "finish the pages")
        add(who, "ADS-AUTHOR-01", F.when(F.col("status") == "OK", "Pass").when(F.col("status").isin("FAIL", "HIGH_RISK"), "Fail").otherwise("Unknown"), named, "say who publishes")
    if duplication is not None:
        high = F.col("duplication") == "high"
        shown = F.format_string("%d of %d pages in groups", "affected", "pages")
        # own pages that differ don't show that nothing is copied from elsewhere
        add(duplication, "ADS-CONTENT-02", F.when(high, "Fail").otherwise("Unknown"), shown, "write own text")
        add(duplication, "ADS-CONTENT-08", judged(~high), shown, "merge alike pages")
    if sellers is not None:
        rows = sellers.where("published is not null")
        listed = F.format_string("ads.txt has %d lines of the ad network", "network_lines")
        add(rows, "ADS-TXT-01", F.when(~F.col("published"), "N/A").otherwise(judged(F.col("network_lines") > 0)), F.when(F.col("published"), listed).otherwise("no ads.txt"), "list the ad network")
        add(rows, "ADS-TXT-02", judged(F.col("published")), F.when(F.col("published"), F.format_string("ads.txt has %d direct sellers", "direct_sellers")).otherwise("no ads.txt"), "publish ads.txt")
    if trust_pages is not None:
        codes = [F.col(c) for c in ("about", "contact", "privacy")]
        gone = F.lit(False)
        for c in codes:
            gone = gone | F.coalesce(c.isin(404, 410), F.lit(False))
        every = (codes[0] == 200) & (codes[1] == 200) & (codes[2] == 200)
        shown = F.concat_ws(", ", *[F.concat(F.lit(f"/{n} "), F.coalesce(c.cast("string"), F.lit("not fetched"))) for n, c in zip(("about", "contact", "privacy"), codes)])
        add(trust_pages, "ADS-UX-05", F.when(gone, "Fail").when(every, "Pass").otherwise("Unknown"), shown, "publish the trust pages")
        add(trust_pages.where("privacy is not null"), "ADS-PRIV-01", F.when(codes[2].isin(404, 410), "Fail").otherwise("Unknown"), F.concat(F.lit("/privacy gives "), codes[2].cast("string")), "publish a privacy policy")
    if trust is not None:
        add(trust, "ADS-AUTHOR-02", judged(F.col("contact")), F.when(F.col("contact"), "a way of contact is named").when(~F.col("contact"), "no way of contact is named").otherwise("about or contact page not fetched"), "name a way of contact")
        add(trust, "ADS-AUTHOR-03", judged(F.col("profile")), F.when(F.col("profile"), "the about page links to a profile").when(~F.col("profile"), "the about page links to no profile").otherwise("about page not fetched"), "link to a profile")
    if sessions is not None:
        add(sessions, "ADS-CRAWL-05", judged(F.col("keyed") == 0), F.format_string("%d of %d URLs name a session or a person", "keyed", "urls"), "keep sessions out of URLs")
    if overlap is not None:
        add(overlap, "ADS-CONTENT-OVERLAP", F.when(F.col("overlap") > 0.6, "Fail").when(F.col("overlap") < 0.4, "Pass").otherwise("Unknown"), F.concat(F.lit("shares "), percent(F.col("overlap")), F.lit(" of a page with another text")), "write own text")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rejection_ids(messages: DataFrame, rejections: DataFrame) -> DataFrame:
    """message_id, theme, id: the requirements to look at for each rejection message."""
    low = F.lower("message")
    return messages.join(F.broadcast(rejections), F.rlike(low, F.col("pattern"))).select("message_id", "reason_no", "theme", "id")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """site, id, both verdicts and what changed between two audits."""
    a = before.select("site", "id", F.col("verdict").alias("before"))
    b = after.select("site", "id", F.col("verdict").alias("after"))
    was, now = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    change = F.when(was == "", "added").when(now == "", "dropped").when(was == now, "same").when(now == "Fail", "regression").when(was == "Fail", F.when(now == "Pass", "fixed").otherwise("open")).otherwise("changed")
    return a.join(b, ["site", "id"], "full_outer").select("site", "id", "before", "after", change.alias("change"))


def markdown(report: DataFrame, ready: DataFrame, cover: DataFrame) -> DataFrame:
    """site, report: decision, failures by severity, the whole checklist and its coverage."""
    line = F.format_string("- `%s`: %s. %s", "id", "evidence", "next_action")

    def section(severity: str) -> Column:
        rows = F.collect_list(F.when((F.col("severity") == severity) & (F.col("verdict") == "Fail"), F.struct("id", line.alias("x"))))
        return F.array_join(F.transform(F.array_sort(rows), lambda r: r["x"]), "\n")

    table = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "id", F.format_string("| %s | %s | %s | %s |", "id", "verdict", "evidence", "next_action").alias("x")))), lambda r: r["x"]), "\n")
    own = report.groupBy("site").agg(section("Blocker").alias("b"), section("High").alias("h"), section("Medium").alias("m"), table.alias("t"))
    every = own.join(ready.select("site", "decision"), "site").join(cover, "site")
    return every.select("site", F.concat(F.lit("**Decision**\n"), "decision", F.lit("\n\n**Blockers**\n"), "b", F.lit("\n\n**High**\n"), "h", F.lit("\n\n**Medium**\n"), "m", F.lit("\n\n**Checklist**\n\n| ID | Verdict | Evidence | Next |\n|-|-|-|-|\n"), "t", F.format_string("\n\n**Coverage**\n%d of %d; missing: %s\n", "in_report", "in_reference", "missing")).alias("report"))
