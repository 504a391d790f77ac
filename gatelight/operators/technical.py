"""Technical checks on a fetch log: one row a site and check, all from one pass over the log.

Statuses are set in the order of the rules, so a later rule overwrites an earlier one, as noted with each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.exact import sitemap
from ..functions.urls import is_https, path

HEADERS = {"content-security-policy": "CSP", "x-frame-options": "Clickjacking protection", "x-content-type-options": "MIME-sniffing protection", "strict-transport-security": "HTTPS enforcement"}
ROBOT = "mediapartners-google"
SLOW_MS, MOST_HOPS = 5000, 2
#: The method of a HEAD request whose redirects aren't followed: the site's own headers are looked at, not a target's.
DIRECT = "HEAD-DIRECT"
ORDER = ("dns_and_uptime", "https", "robots.txt", "sitemap.xml", "redirects", "security_headers")


def _issues(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda x: x.isNotNull())


def _result(check: str, status: Column, issues: Column, details: Column) -> Column:
    shown = F.map_filter(details, lambda _, v: v.isNotNull())
    return F.struct(F.lit(check).alias("check"), status.alias("status"), issues.alias("issues"), shown.alias("details"))


def _details(**items: Column) -> Column:
    return F.create_map(*[x for k, v in items.items() for x in (F.lit(k), v.cast("string"))])


def site_fetches(fetches: DataFrame) -> DataFrame:
    """One row a site with the fetches that the checks look at, as structs. No other body leaves the scan."""
    at = path(F.col("requested_url"))
    looked_at = fetches.where(at.isin("", "/", "/about", "/contact", "/robots.txt", "/sitemap.xml", "/ads.txt", "/privacy"))
    row = F.struct("requested_url", "final_url", "status", "body", "headers", "redirect_count", "elapsed_ms", "ssl_error", "error_kind", "error")

    def first(condition: Column, name: str) -> Column:
        return F.min_by(F.when(condition, row), F.when(condition, F.col("seq"))).alias(name)

    # a HEAD that follows redirects, and one that doesn't
    get, head, direct = (F.col("method") == m for m in ("GET", "HEAD", DIRECT))
    root = at.isin("", "/")
    found = looked_at.groupBy("site").agg(
        first(get & root, "home"), first(get & (at == "/about"), "about"), first(get & (at == "/contact"), "contact"), first(get & (at == "/robots.txt"), "robots"),
        first(get & (at == "/sitemap.xml"), "map"), first(get & (at == "/ads.txt"), "sellers"), first(head & root, "head"), first(direct & root, "direct"), first(get & (at == "/privacy"), "privacy"))
    return fetches.select("site").distinct().join(found, "site", "left")


def robots(r: Column, rfc: bool = False) -> Column:
    """A rule for all crawlers FAILs as soon as any path is disallowed; a named last group then makes it WARNING."""
    low = F.lower(r["body"])
    agents = F.contains(low, F.lit("user-agent:"))
    blocked = agents & F.contains(low, F.lit("*")) & F.contains(low, F.lit("disallow: /"))
    last = F.element_at(F.split(low, "user-agent:"), -1)
    named = agents & F.contains(last, F.lit(ROBOT)) & F.contains(low, F.lit("disallow:"))
    if rfc:
        blocked, named = rfc_blocked(low, "*"), rfc_blocked(low, ROBOT)
    found = r["status"] == 200
    status = F.when(r["error"].isNotNull() | r["status"].isNull(), "ERROR").when(~found, "MISSING").when(named, "WARNING").when(blocked, "FAIL").otherwise("OK")
    issues = F.when(r["error"].isNotNull() | r["status"].isNull(), _issues(F.coalesce(r["error"], F.lit("not fetched")))).when(~found, _issues(F.concat(F.lit("robots.txt gives "), r["status"].cast("string")))).otherwise(
        _issues(F.when(blocked, "all crawlers are disallowed"), F.when(named, "the ads crawler may be blocked")))
    return _result("robots.txt", status, issues, _details(http_status=r["status"], found=F.when(found, "true"), snippet=F.when(found, F.substring(low, 1, 300))))


def rfc_blocked(low: Column, agent: str) -> Column:
    """By groups: whether the agent's own group disallows the whole site and nothing allows it."""
    quoted = agent.replace("*", r"\*")
    group = F.regexp_extract(low, rf"(?s)user-agent:[ \t]*{quoted}[ \t]*(?:#[^\n]*)?\r?\n((?:(?!\n[ \t]*user-agent:).)*)", 1)
    return F.rlike(group, F.lit(r"(?m)^[ \t]*disallow:[ \t]*/\*?[ \t]*(#.*)?\r?$")) & ~F.rlike(group, F.lit(r"(?m)^[ \t]*allow:[ \t]*/[ \t]*(#.*)?\r?$"))


def site_map(r: Column, parsed: Column) -> Column:
    found = r["status"] == 200
    n = F.size(parsed["urls"])
    status = F.when(r["error"].isNotNull() | r["status"].isNull(), "ERROR").when(~found, "MISSING").when(~parsed["valid"] | (n == 0), "WARNING").otherwise("OK")
    issue = F.when(r["error"].isNotNull() | r["status"].isNull(), F.coalesce(r["error"], F.lit("not fetched"))).when(~found, F.concat(F.lit("sitemap.xml gives "), r["status"].cast("string"))).when(~parsed["valid"], "sitemap.xml is no valid XML").when(n == 0, "sitemap.xml has no URLs")
    sound = found & parsed["valid"]
    return _result("sitemap.xml", status, _issues(issue), _details(http_status=r["status"], url_count=F.when(sound, n), found=F.when(sound, "true"), first_urls=F.when(sound & (n > 0), F.array_join(F.slice(parsed["urls"], 1, 3), ", "))))


def redirects(r: Column) -> Column:
    hops, bad = r["redirect_count"] > MOST_HOPS, r["status"] >= 400
    failed, unseen = r["error"].isNotNull() | r["status"].isNull(), r["redirect_count"].isNull()
    status = F.when(failed, "ERROR").when(bad, "FAIL").when(unseen, "ERROR").when(hops, "WARNING").otherwise("OK")
    issues = F.when(failed, _issues(F.coalesce(r["error"], F.lit("not fetched")))).otherwise(_issues(F.when(hops, F.concat(r["redirect_count"].cast("string"), F.lit(" redirects"))), F.when(bad, F.concat(F.lit("ends with "), r["status"].cast("string"))), F.when(~bad & unseen, "redirects weren't recorded")))
    return _result("redirects", status, issues, _details(redirect_count=r["redirect_count"], final_url=r["final_url"]))


def headers(r: Column) -> Column:
    failed = r["error"].isNotNull() | r["status"].isNull()
    unseen = r["headers"].isNull()
    low = F.transform_keys(r["headers"], lambda k, _: F.lower(k))
    value = {h: F.element_at(low, F.lit(h)) for h in HEADERS}
    missing = _issues(*[F.when(value[h].isNull(), F.lit(f"{name} header is missing ({h})")) for h, name in HEADERS.items()])
    issues = F.when(failed, _issues(F.coalesce(r["error"], F.lit("not fetched")))).when(unseen, F.array(F.lit("headers weren't recorded"))).otherwise(missing)
    status = F.when(failed | unseen, "ERROR").when(F.size(missing) > 0, "WARNING").otherwise("OK")
    return _result("security_headers", status, issues, F.create_map(*[x for h, name in HEADERS.items() for x in (F.lit(name), F.concat(F.substring(value[h], 1, 50), F.lit("...")))]))


def https(r: Column) -> Column:
    secure = is_https(r["requested_url"])
    broken, unseen = F.coalesce(r["ssl_error"], F.lit(False)), r["requested_url"].isNull()
    status = F.when(unseen, "ERROR").when(~secure, "WARNING").when(broken, "FAIL").when(r["error"].isNotNull(), "ERROR").otherwise("OK")
    issue = F.when(unseen, "not fetched").when(~secure, "the site does without HTTPS").when(broken, "the certificate can't be verified").when(r["error"].isNotNull(), r["error"])
    return _result("https", status, _issues(issue), _details(ssl_verified=F.when(secure & ~broken & r["error"].isNull(), "true")))


def uptime(r: Column) -> Column:
    """A slow answer is a WARNING even where the server failed."""
    lost = r["error_kind"] == "connection"
    failed = r["error"].isNotNull() | r["status"].isNull()
    ms = F.round(r["elapsed_ms"], 2)
    down, slow = r["status"] >= 500, ms > SLOW_MS
    status = F.when(F.coalesce(lost, F.lit(False)), "FAIL").when(failed, "ERROR").when(slow, "WARNING").when(down, "FAIL").otherwise("OK")
    issues = F.when(F.coalesce(lost, F.lit(False)), F.array(F.lit("no connection"))).when(failed, _issues(F.coalesce(r["error"], F.lit("not fetched")))).otherwise(
        _issues(F.when(down, F.concat(F.lit("the server gives "), r["status"].cast("string"))), F.when(slow, F.concat(F.lit("slow: "), ms.cast("string"), F.lit(" ms")))))
    return _result("dns_and_uptime", status, issues, _details(http_status=r["status"], response_time_ms=ms))


def checks(fetches: DataFrame, rfc: bool = False) -> DataFrame:
    """site, pos, check, status, issues, details: the six checks of every site in their order."""
    own = site_fetches(fetches)
    own = own.withColumn("sound", sitemap(F.col("map.body")))
    home, head, direct = F.col("home"), F.coalesce("head", "home"), F.coalesce("direct", "head", "home")
    each = [uptime(home), https(home), robots(F.col("robots"), rfc), site_map(F.col("map"), F.col("sound")), redirects(head), headers(direct)]
    return own.select("site", F.posexplode(F.array(*each)).alias("pos", "c")).select("site", "pos", "c.*")


def summary(found: DataFrame) -> DataFrame:
    """A line a site. MISSING counts neither as a failure nor as a warning."""
    fails, warns = F.count_if(F.col("status").isin("FAIL", "ERROR")), F.count_if(F.col("status") == "WARNING")
    message = F.when(fails > 0, F.concat(fails.cast("string"), F.lit(" critical"))).when(warns > 0, F.concat(warns.cast("string"), F.lit(" to review"))).otherwise("all passed")
    return found.groupBy("site").agg(fails.alias("failures"), warns.alias("warnings"), message.alias("message"))


def lines(found: DataFrame, width: int = 20) -> DataFrame:
    """Console lines a check: mark, name and status, then issues and details; details longer than 60 are cut."""
    head = F.concat(text.symbol(F.col("status")), F.lit(" "), text.padded(F.col("check"), width), F.lit(" | "), text.padded(F.col("status"), 10))
    issues = F.transform("issues", lambda x: F.concat(F.lit("   → "), x))
    details = F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(F.lit("   • "), e["key"], F.lit(": "), text.clipped(e["value"], 60)))
    return found.select("site", "pos", F.array_join(F.concat(F.array(head), issues, details), "\n").alias("lines"))


def report(found: DataFrame, title: str) -> DataFrame:
    """A text report a site: its checks in order with all issues and details."""
    issues = F.transform("issues", lambda x: F.concat(F.lit("  - "), x, F.lit("\n")))
    details = F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = "), e["value"], F.lit("\n")))
    one = F.concat(F.col("check"), F.lit(": "), F.col("status"), F.lit("\n"), F.array_join(issues, ""), F.array_join(details, ""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("x")))), lambda r: r["x"]), "\n")
    return found.groupBy("site").agg(F.concat(F.lit(f"{title}\nSite: "), F.col("site"), F.lit("\n\n"), body).alias("report"))


def seller_file(fetches: DataFrame) -> DataFrame:
    """site, published (null if /ads.txt wasn't fetched), and how many of its lines name a seller directly, and the ad network so."""
    own = site_fetches(fetches)
    code = F.when(F.col("sellers.error").isNull(), F.col("sellers.status"))
    listed = F.split(F.lower(F.coalesce("sellers.body", F.lit(""))), "\n")
    direct = F.filter(listed, lambda x: F.rlike(x, F.lit(r"^\s*[^#,\s]+\s*,\s*[^,\s]+\s*,\s*direct\b")))
    network = F.filter(direct, lambda x: F.rlike(x, F.lit(r"^\s*google\.com\s*,")))
    good = code == 200
    return own.select("site", good.alias("published"), F.when(good, F.size(direct)).otherwise(0).alias("direct_sellers"), F.when(good, F.size(network)).otherwise(0).alias("network_lines"))


def trust_pages(fetches: DataFrame) -> DataFrame:
    """site and the statuses of /about, /contact and /privacy; null where they weren't fetched or failed."""
    own = site_fetches(fetches)
    return own.select("site", *[F.when(F.col(f"{p}.error").isNull(), F.col(f"{p}.status")).alias(p) for p in ("about", "contact", "privacy")])
