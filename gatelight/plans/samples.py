"""Small hand-made inputs for the checks that the stored tables have no rows for, as rows and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.fetches import FETCHES

_MANY = " ".join(["useful"] * 120)
_MAP = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://{0}/a</loc></url><url><loc>https://{0}/b</loc></url></urlset>'
_GOOD_HEADERS = {"Content-Security-Policy": "default-src 'self'", "X-Frame-Options": "DENY", "X-Content-Type-Options": "nosniff", "Strict-Transport-Security": "max-age=31536000"}


def _page(text: str) -> str:
    return f"<html><head><title>t</title></head><body><p>{text}</p></body></html>"


def _site(site: str, home: str | None, about: tuple[int, str], contact: tuple[int, str], robots: tuple[int, str], sitemap: tuple[int, str], *, status: int = 200, hops: int = 0, ms: float = 120.0, headers: dict | None = None, scheme: str = "https", ssl: bool = False, kind: str | None = None, error: str | None = None, head_status: int | None = None) -> list[tuple]:
    def row(path: str, method: str, code: int | None, body: str | None) -> list:
        url = f"{scheme}://{site}{path}"
        return [site, url, url, method, code, body, headers or {}, hops, ms, ssl, kind, error]

    code = None if error else status
    rows = [row("/", "GET", code, home), row("/about", "GET", None if kind else about[0], about[1]), row("/contact", "GET", None if kind else contact[0], contact[1])]
    rows += [row("/robots.txt", "GET", None if kind else robots[0], robots[1]), row("/sitemap.xml", "GET", None if kind else sitemap[0], sitemap[1]), row("/", "HEAD", None if error else head_status or status, None)]
    return [(*r, i) for i, r in enumerate(rows)]


_OPEN = (200, "User-agent: *\nAllow: /\n")
FETCH_ROWS = [
    *_site("good.example", _page("Welcome " + _MANY), (200, _page("Jane Miller is an engineer. Contact jane email@good.example " + _MANY)), (200, _page("Write to jane@good.example")), _OPEN, (200, _MAP.format("good.example")), headers=_GOOD_HEADERS),
    *_site("unfinished.example", _page("Coming soon, not yet here"), (404, ""), (200, _page("An address will be added")), (404, ""), (404, "")),
    *_site("anonymous.example", _page("Welcome " + _MANY), (200, _page("we like things " + _MANY)), (200, _page("Use the form")), (200, "User-agent: *\nDisallow: /admin\n"), (200, "<urlset>")),
    *_site("blocked.example", _page("Hello"), (200, _page("Too short")), (200, _page("todo")), (200, "User-agent: *\nDisallow: /\nUser-agent: Mediapartners-Google\nDisallow: /\n"), (200, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"></urlset>'), scheme="http", hops=3, head_status=404),
    *_site("slow.example", _page("x"), (500, ""), (503, ""), _OPEN, (200, _MAP.format("slow.example")), status=503, ms=6000.25),
    *_site("gone.example", None, (0, ""), (0, ""), (0, ""), (0, ""), kind="connection", error="no route to host"),
    *_site("badcert.example", None, (200, _page("Ann Lee " + _MANY)), (200, _page("mail me @ home")), _OPEN, (500, ""), ssl=True, error="certificate verify failed"),
]

#: site, id, verdict, severity, evidence, next_action
FINDINGS = [
    ("a.example", "ADS-CONTENT-02", "Fail", "High", "40 of 50 pages alike", "write own text"),
    ("a.example", "ADS-CONTENT-03", "Fail", None, "12 of 50 pages thin", "extend pages"),
    ("a.example", "ADS-CONTENT-03", "Pass", None, "seen by hand", ""),
    ("a.example", "ADS-UX-05", "Pass", None, "", ""),
    ("a.example", "ADS-ELIG-01", "Pass", None, "account page", ""),
    ("a.example", "ADS-PROG-07", "N/A", None, "no app", ""),
    ("b.example", "ADS-CRAWL-02", "Fail", None, "robots blocks all", "allow crawlers"),
    ("b.example", "ADS-PRIV-01", "Pass", None, "/privacy", ""),
    ("b.example", "ADS-PRIV-10", "Fail", None, "no controls", "add controls"),
    ("c.example", "ADS-PRIV-01", "Unknown", None, "", "ask the owner"),
]
AFTER = [
    ("a.example", "ADS-CONTENT-02", "Pass"), ("a.example", "ADS-CONTENT-03", "Fail"), ("a.example", "ADS-UX-05", "Fail"), ("a.example", "ADS-ELIG-01", "Pass"),
    ("b.example", "ADS-CRAWL-02", "Unknown"), ("b.example", "ADS-PRIV-01", "Pass"), ("c.example", "ADS-AUTHOR-01", "Fail"),
]
BEFORE = [
    ("a.example", "ADS-CONTENT-02", "Fail"), ("a.example", "ADS-CONTENT-03", "Fail"), ("a.example", "ADS-UX-05", "Pass"), ("a.example", "ADS-ELIG-01", "Unknown"), ("a.example", "ADS-OWN-01", "Pass"),
    ("b.example", "ADS-CRAWL-02", "Fail"), ("b.example", "ADS-PRIV-01", "Pass"),
]
MESSAGES = [(1, "We found low value content on your site"), (2, "Your site has insufficient ORIGINAL content"), (3, "Thin pages"), (4, "Our crawler cannot access your site"), (5, "Incomplete privacy policy"), (6, "Ad placement violations"), (7, "Policy violation: adult"), (8, "Something else")]
#: site, id, severity, verdict, title, evidence, files (joined), effort_hours
WORK = [
    ("a.example", "ADS-CONTENT-02", "Blocker", "Fail", "Write own text", "40 pages alike", "p1 p2 p3", 8.0), ("a.example", "ADS-AUTHOR-01", "Blocker", "Fail", "Name the publisher", "no name", "about", 1.5),
    ("a.example", "ADS-CONTENT-03", "High", "Fail", "Extend thin pages", "12 thin pages", "p4 p5", 6.0), ("a.example", "ADS-UX-05", "Medium", "Fail", "Add trust pages", "no terms", "terms", 2.0), ("a.example", "ADS-ELIG-01", "Blocker", "Pass", "Account", "seen", "none", 0.0),
    ("b.example", "ADS-CRAWL-02", "Blocker", "Fail", "Allow crawlers", "robots blocks", "robots.txt", 0.5), ("b.example", "ADS-PRIV-02", "High", "Fail", "Disclose cookies", "no word of them", "privacy", 1.0), ("b.example", "ADS-PRIV-04", "High", "Fail", "Ask for consent", "no banner", "layout", 1.0),
]
#: site, rubric, check_id, passed, overlap
RATINGS = [(f"{r}{k}.example", r, f"{r.upper()}-{n:02d}", n <= good, over) for k, (r, good, over) in enumerate([("tool", 9, None), ("tool", 6, None), ("tool", 3, None), ("quiz", 8, 0.2), ("quiz", 8, 0.5), ("quiz", 4, 0.1)]) for n in range(1, 11)]

#: site, leader, source, member, url, sim: groups of similar pages, flat
SIMILAR = [
    ("a.example", 1, "https://a.example/" + "long-path/" * 8, 2, "https://a.example/two", 0.925), ("a.example", 1, "https://a.example/" + "long-path/" * 8, 5, "https://a.example/" + "another-path/" * 6, 0.875),
    ("a.example", 3, "https://a.example/three", 4, "https://a.example/four", 1.0), ("b.example", 1, "https://b.example/one", 9, "https://b.example/nine", 0.8),
]
CORPUS = [*[("a.example", k) for k in range(1, 6)], *[("b.example", k) for k in range(1, 10)], ("c.example", 1)]

SHAPES = {
    "alike": (SIMILAR, "site string, leader long, source string, member long, url string, sim double"),
    "corpus": (CORPUS, "site string, seq long"),
    "findings": (FINDINGS, "site string, id string, verdict string, severity string, evidence string, next_action string"),
    "before": (BEFORE, "site string, id string, verdict string"),
    "after": (AFTER, "site string, id string, verdict string"),
    "messages": (MESSAGES, "message_id int, message string"),
    "work": (WORK, "site string, id string, severity string, verdict string, title string, evidence string, file_list string, effort_hours double"),
    "ratings": (RATINGS, "site string, rubric string, check_id string, passed boolean, overlap double"),
}


def fetches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FETCH_ROWS, FETCHES)


def sample(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(*SHAPES[name])


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, dict):
        return f"MAP {{{', '.join(f'{literal(k)}: {literal(v)}' for k, v in x.items())}}}" if x else "MAP([]::VARCHAR[], []::VARCHAR[])"
    return "'" + str(x).replace("'", "''") + "'"


_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "map<string,string>": "MAP(VARCHAR, VARCHAR)"}


def values(name: str, rows: list[tuple], schema: str) -> str:
    """A common table expression with the same rows."""
    cols = [c.strip().rsplit(" ", 1) for c in schema.replace("map<string,string>", "map<string;string>").split(",")]
    kinds = [(n, _SQL_TYPES[t.replace(";", ",")]) for n, t in cols]
    body = ",\n".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"{name} AS (SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in kinds)} FROM (VALUES {body}) v({', '.join(n for n, _ in kinds)}))"


def values_of(name: str) -> str:
    return values(name, *SHAPES[name])


def fetch_values() -> str:
    return values("fetches", FETCH_ROWS, FETCHES)
