"""The same results in DuckDB's SQL, for the queries that SQL can express."""

from __future__ import annotations

from .functions import html, text, urls
from .operators import policy
from .operators.completeness import PROFILE
from .operators.technical import HEADERS
from .plans import registry, samples

_REQ = samples.values("requirements", registry.REQUIREMENTS, "section string, id string, severity string, evidence_source string, topic string")
_RUB = samples.values("rubrics", registry.RUBRICS, "rubric string, check_id string, area string, mode string, asks string")
_BEARS = samples.values("bears", registry.BEARS, "rubric string, id string, check_id string")
_REJ = samples.values("rejections", registry.REJECTIONS, "reason_no int, pattern string, theme string, id string")
_WS = r"[\s\x0B]+"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sub(expr: str, pattern: str, by: str = " ", flags: str = "g") -> str:
    return f"regexp_replace({expr}, {_q(pattern)}, {_q(by)}, '{flags}')"


def _decoded(expr: str) -> str:
    for name, char in html.ENTITIES.items():
        expr = f"replace({expr}, {_q(name)}, {_q(char)})"
    return expr


def _squeezed(expr: str) -> str:
    return f"trim({_sub(expr, _WS)})"


def depth_text(expr: str) -> str:
    expr = _sub(expr, html.COMMENT)
    for tag in html.SKIPPED:
        expr = _sub(expr, html.skip_pattern(tag))
    return _squeezed(_decoded(_sub(expr, html.TAG)))


def dup_text(expr: str) -> str:
    expr = _sub(expr, html.COMMENT)
    for pattern in (*map(html.skip_pattern, html.SKIPPED), html.TAG):
        expr = _sub(expr, pattern, "\x01")
    chunks = f"list_transform(string_split({expr}, chr(1)), lambda x: trim({_decoded('x')}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
    return f"array_to_string(list_filter({chunks}, lambda x: length(x) > 2), chr(10))"


def body_text(expr: str) -> str:
    inner = f"regexp_extract({expr}, {_q(r'(?is)<body\b[^>]*>(.*?)(</body\s*>|\z)')}, 1)"
    return _squeezed(_decoded(_sub(_sub(inner, html.COMMENT), html.TAG)))


def words(expr: str) -> str:
    return f"coalesce(CAST(len(list_filter(regexp_split_to_array({expr}, {_q(_WS)}), lambda w: w <> '')) AS INTEGER), 0)"


def risk(n: str) -> str:
    return f"CASE WHEN {n} < 300 THEN 'THIN' WHEN {n} < 450 THEN 'BORDERLINE' ELSE 'OK' END"


def _depth(table: str, key: str, body: str, content: str) -> str:
    return f"""
WITH t AS (SELECT {key}, {body} AS body, {content} AS txt FROM {table}),
m AS (SELECT *, {words('txt')} AS word_count, length(body) / 1024.0::DOUBLE AS kb FROM t)
SELECT {key}, word_count, round(CASE WHEN kb > 0 THEN word_count / kb ELSE 0.0 END, 2) AS text_density, round(kb, 2) AS content_length_kb,
       {risk('word_count')} AS risk, CASE WHEN length(txt) > 200 THEN substr(txt, 1, 200) || '...' ELSE txt END AS sample_text
FROM m"""


_AUTH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"


def authority(url: str) -> str:
    return f"regexp_extract({url}, {_q(_AUTH)}, 1)"


def _first(expr: str, tag: str) -> str:
    found = f"regexp_extract_all(substr({expr}, 1, {html.PREFIX}), {_q(rf'(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>')}, 1)"
    return f"trim({_decoded(_sub(f'array_to_string({found}, {_q(str())})', r'<[^>]*>', ''))})"


_DESC = f"regexp_extract_all(regexp_extract(substr(html, 1, {html.PREFIX}), {_q(r'(?is)<head\b[^>]*>(.*?)(</head\s*>|\z)')}, 1), {_q(html.META)})"
_LINKS = f"list_filter(regexp_extract_all(html, {_q(html.LINK)}, 1), lambda x: NOT starts_with(x, '#'))"
_PAGES = f"pg AS (SELECT page_id, url, {authority('url')} AS site, html, {words(depth_text('html'))} AS n FROM pages)"


def _found(expr: str) -> str:
    return f"list_filter([{', '.join(map(_q, text.PLACEHOLDERS))}], lambda p: contains(lower({expr}), p))"


def _any(expr: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), {_q(p)})" for p in phrases) + ")"


def _name(expr: str) -> str:
    return f"regexp_matches({expr}, {_q(r'(^|[\s\x0B])\p{Lu}[^\s\x0B]{2,}[\s\x0B]+\p{Lu}[^\s\x0B]{2,}([\s\x0B]|$)')})"


def _mail(expr: str) -> str:
    return f"(contains(lower({expr}), 'email') OR contains({expr}, '@'))"


_FETCH = samples.fetch_values()
_AT = "regexp_extract(requested_url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def _at(name: str, where: str) -> str:
    return f"{name} AS (SELECT * FROM fetches WHERE {where} QUALIFY row_number() OVER (PARTITION BY site ORDER BY seq) = 1)"


def _path(name: str, *paths: str) -> str:
    return _at(name, f"method = 'GET' AND {_AT} IN ({', '.join(map(_q, paths))})")


def _issues(*cases: str) -> str:
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), '; ')"


_LOST = "(error IS NOT NULL OR status IS NULL)"
_NOT = "[coalesce(error, 'not fetched')]"


def _pages_as_fetches() -> str:
    """The stored pages in the form of a fetch log."""
    return f"""fetches AS (SELECT {authority('url')} AS site, url AS requested_url, url AS final_url, 'GET' AS method, 200 AS status, html AS body, CAST(NULL AS MAP(VARCHAR, VARCHAR)) AS headers, CAST(NULL AS INTEGER) AS redirect_count,
    CAST(NULL AS DOUBLE) AS elapsed_ms, CAST(NULL AS BOOLEAN) AS ssl_error, CAST(NULL AS VARCHAR) AS error_kind, CAST(NULL AS VARCHAR) AS error, page_id AS seq FROM pages)"""


def _some(*cases: str) -> str:
    return f"list_filter(CAST([{', '.join(cases)}] AS VARCHAR[]), lambda x: x IS NOT NULL)"


def _pairs(**items: str) -> str:
    """Details in the order of their names, those without a value left out."""
    each = ", ".join(f"{{'k': {_q(k)}, 'v': CAST({items[k]} AS VARCHAR)}}" for k in sorted(items))
    return f"list_filter([{each}], lambda x: x.v IS NOT NULL)"


def _check(pos: int, name: str, of: str, status: str, issues: str, details: str) -> str:
    return f'SELECT site, {pos} AS pos, {_q(name)} AS "check", {status} AS status, {issues} AS issues, {details} AS details FROM {of}'


def _technical(fetch: str) -> str:
    """The six checks of every site over a fetch log."""
    joined = lambda name, *of: f"{name}_ AS (SELECT sites.site, {', '.join(f'coalesce({', '.join(f'{o}.{c}' for o in of)}) AS {c}' if len(of) > 1 else f'{of[0]}.{c} AS {c}' for c in ('requested_url', 'final_url', 'status', 'body', 'headers', 'redirect_count', 'elapsed_ms', 'ssl_error', 'error_kind', 'error'))} FROM sites {' '.join(f'LEFT JOIN {o} ON {o}.site = sites.site' for o in of)})"
    sound = r"regexp_matches(body, '^\s*(<\?xml[^>]*\?>)?\s*<urlset[^>]*>.*</urlset>\s*$', 's')"
    urls = "regexp_extract_all(body, '<loc>([^<]*)</loc>', 1)"
    have = "map_from_entries(list_transform(map_entries(headers), lambda e: {'k': lower(e.key), 'v': e.value}))"
    blocked = "(contains(lower(body), 'user-agent:') AND contains(lower(body), '*') AND contains(lower(body), 'disallow: /'))"
    named = "(contains(lower(body), 'user-agent:') AND contains(string_split(lower(body), 'user-agent:')[-1], 'mediapartners-google') AND contains(lower(body), 'disallow:'))"
    missing = _some(*[f"CASE WHEN {have}[{_q(h)}] IS NULL THEN {_q(f'{n} header is missing ({h})')} END" for h, n in HEADERS.items()])
    ms = "round(elapsed_ms, 2)"
    gone = "coalesce(error_kind, '') = 'connection'"
    each = [
        _check(0, "dns_and_uptime", "home_", f"CASE WHEN {gone} THEN 'FAIL' WHEN {_LOST} THEN 'ERROR' WHEN {ms} > 5000 THEN 'WARNING' WHEN status >= 500 THEN 'FAIL' ELSE 'OK' END",
               f"CASE WHEN {gone} THEN ['no connection'] WHEN {_LOST} THEN {_NOT} ELSE {_some("CASE WHEN status >= 500 THEN 'the server gives ' || status END", f"CASE WHEN {ms} > 5000 THEN 'slow: ' || CAST({ms} AS VARCHAR) || ' ms' END")} END", _pairs(http_status="status", response_time_ms=ms)),
        _check(1, "https", "home_", "CASE WHEN requested_url IS NULL THEN 'ERROR' WHEN NOT starts_with(requested_url, 'https://') THEN 'WARNING' WHEN coalesce(ssl_error, false) THEN 'FAIL' WHEN error IS NOT NULL THEN 'ERROR' ELSE 'OK' END",
               _some("CASE WHEN requested_url IS NULL THEN 'not fetched' WHEN NOT starts_with(requested_url, 'https://') THEN 'the site does without HTTPS' WHEN coalesce(ssl_error, false) THEN 'the certificate can''t be verified' WHEN error IS NOT NULL THEN error END"),
               _pairs(ssl_verified="CASE WHEN starts_with(requested_url, 'https://') AND NOT coalesce(ssl_error, false) AND error IS NULL THEN 'true' END")),
        _check(2, "robots.txt", "robots_", f"CASE WHEN {_LOST} THEN 'ERROR' WHEN status <> 200 THEN 'MISSING' WHEN {named} THEN 'WARNING' WHEN {blocked} THEN 'FAIL' ELSE 'OK' END",
               f"CASE WHEN {_LOST} THEN {_NOT} WHEN status <> 200 THEN ['robots.txt gives ' || status] ELSE {_some(f"CASE WHEN {blocked} THEN 'all crawlers are disallowed' END", f"CASE WHEN {named} THEN 'the ads crawler may be blocked' END")} END",
               _pairs(http_status="status", found="CASE WHEN status = 200 THEN 'true' END", snippet="CASE WHEN status = 200 THEN substr(lower(body), 1, 300) END")),
        _check(3, "sitemap.xml", "map_", f"CASE WHEN {_LOST} THEN 'ERROR' WHEN status <> 200 THEN 'MISSING' WHEN NOT {sound} OR len({urls}) = 0 THEN 'WARNING' ELSE 'OK' END",
               f"CASE WHEN {_LOST} THEN {_NOT} ELSE {_some(f"CASE WHEN status <> 200 THEN 'sitemap.xml gives ' || status WHEN NOT {sound} THEN 'sitemap.xml is no valid XML' WHEN len({urls}) = 0 THEN 'sitemap.xml has no URLs' END")} END",
               _pairs(http_status="status", url_count=f"CASE WHEN status = 200 AND {sound} THEN len({urls}) END", found=f"CASE WHEN status = 200 AND {sound} THEN 'true' END", first_urls=f"CASE WHEN status = 200 AND {sound} AND len({urls}) > 0 THEN array_to_string({urls}[1:3], ', ') END")),
        _check(4, "redirects", "hops_", f"CASE WHEN {_LOST} THEN 'ERROR' WHEN status >= 400 THEN 'FAIL' WHEN redirect_count IS NULL THEN 'ERROR' WHEN redirect_count > 2 THEN 'WARNING' ELSE 'OK' END",
               f"CASE WHEN {_LOST} THEN {_NOT} ELSE {_some("CASE WHEN redirect_count > 2 THEN redirect_count || ' redirects' END", "CASE WHEN status >= 400 THEN 'ends with ' || status END", "CASE WHEN status < 400 AND redirect_count IS NULL THEN 'redirects weren''t recorded' END")} END", _pairs(redirect_count="redirect_count", final_url="final_url")),
        _check(5, "security_headers", "own_", f"CASE WHEN {_LOST} OR headers IS NULL THEN 'ERROR' WHEN len({missing}) > 0 THEN 'WARNING' ELSE 'OK' END", f"CASE WHEN {_LOST} THEN {_NOT} WHEN headers IS NULL THEN ['headers weren''t recorded'] ELSE {missing} END",
               _pairs(**{n: f"substr({have}[{_q(h)}], 1, 50) || '...'" for h, n in HEADERS.items()})),
    ]
    root = f"{_AT} IN ('', '/')"
    return f"""{fetch}, sites AS (SELECT DISTINCT site FROM fetches), {_path('home', '', '/')}, {_path('robots', '/robots.txt')}, {_path('map', '/sitemap.xml')}, {_at('head', f"method = 'HEAD' AND {root}")}, {_at('direct', f"method = 'HEAD-DIRECT' AND {root}")},
{joined('home', 'home')}, {joined('robots', 'robots')}, {joined('map', 'map')},
hops_ AS (SELECT sites.site, h.* EXCLUDE (site) FROM sites LEFT JOIN (SELECT * FROM head UNION ALL SELECT * FROM home WHERE site NOT IN (SELECT site FROM head)) h ON h.site = sites.site),
own_ AS (SELECT sites.site, h.* EXCLUDE (site) FROM sites LEFT JOIN (SELECT * FROM direct UNION ALL SELECT * FROM head WHERE site NOT IN (SELECT site FROM direct) UNION ALL SELECT * FROM home WHERE site NOT IN (SELECT site FROM head UNION SELECT site FROM direct)) h ON h.site = sites.site),
checks AS ({' UNION ALL '.join(each)})"""


def _complete(fetch: str, more: bool = False) -> str:
    """The two checks of completeness of every site over a fetch log; ``more`` where the log and its paths are there already."""
    texts = f"{'' if more else f'{fetch}, sites AS (SELECT DISTINCT site FROM fetches), {_path("home", "", "/")}, '}{_path('about', '/about')}, {_path('contact', '/contact')}, {_path('privacy', '/privacy')}, {_path('sellers', '/ads.txt')}"
    return f"""{texts},
s AS (SELECT sites.site, home.status AS home, about.status AS about, contact.status AS contact, {body_text("coalesce(home.body, '')")} AS ht, {body_text("coalesce(about.body, '')")} AS abt, {body_text("coalesce(contact.body, '')")} AS ct
      FROM sites LEFT JOIN home USING (site) LEFT JOIN about USING (site) LEFT JOIN contact USING (site)),
p AS (SELECT *, {_found('ht')} AS hp, {_found('abt')} AS ap, {_found('ct')} AS cp, {words('abt')} AS an, coalesce(home, 0) <> 200 AS dead FROM s),
c AS (SELECT *, {_some("CASE WHEN len(hp) > 0 THEN 'homepage has unfinished phrases: ' || array_to_string(hp, ', ') END",
        "CASE WHEN about = 404 THEN 'about page missing' WHEN about = 200 AND an < 100 THEN 'about page is a stub' WHEN about = 200 AND len(ap) > 0 THEN 'about page has unfinished phrases: ' || array_to_string(ap, ', ') END",
        f"CASE WHEN contact = 404 THEN 'contact page missing' WHEN contact = 200 AND len(cp) > 0 THEN 'contact page has unfinished phrases: ' || array_to_string(cp, ', ') WHEN contact = 200 AND NOT {_mail('ct')} THEN 'contact page has no address' END")} AS found FROM p),
complete AS (SELECT site, 0 AS pos, 'site_completeness' AS "check",
        CASE WHEN dead OR len(found) >= 4 THEN 'FAIL' WHEN len(found) >= 2 THEN 'HIGH_RISK' WHEN len(hp) > 0 THEN 'WARNING' ELSE 'OK' END AS status,
        CASE WHEN dead THEN ['homepage gives ' || coalesce(CAST(home AS VARCHAR), 'None')] ELSE found END AS issues,
        {_pairs(about_page="CASE WHEN NOT dead THEN CASE WHEN about = 404 THEN 'MISSING' WHEN about = 200 THEN CASE WHEN an < 100 THEN 'STUB' ELSE 'OK' END ELSE 'ERROR (' || coalesce(CAST(about AS VARCHAR), 'None') || ')' END END",
                contact_page=f"CASE WHEN NOT dead THEN CASE WHEN contact = 404 THEN 'MISSING' WHEN contact = 200 THEN CASE WHEN len(cp) > 0 THEN 'PLACEHOLDER' WHEN NOT {_mail('ct')} THEN 'NO_EMAIL' ELSE 'OK' END ELSE 'ERROR (' || coalesce(CAST(contact AS VARCHAR), 'None') || ')' END END")} AS details FROM c),
identity AS (SELECT site, 1 AS pos, 'publisher_identity' AS "check",
        CASE WHEN about = 404 THEN 'FAIL' WHEN coalesce(about, 0) <> 200 THEN 'ERROR' WHEN NOT {_name('abt')} OR NOT {_any('abt', text.CONTACT)} THEN 'HIGH_RISK' ELSE 'OK' END AS status,
        CASE WHEN about = 404 THEN ['about page missing'] WHEN coalesce(about, 0) <> 200 THEN ['about page can''t be read (' || coalesce(CAST(about AS VARCHAR), 'None') || ')']
             ELSE {_some(f"CASE WHEN NOT {_name('abt')} THEN 'no name of a person found' END", f"CASE WHEN NOT {_any('abt', text.CONTACT)} THEN 'no way of contact visible' END", f"CASE WHEN NOT {_any('abt', text.CREDENTIALS)} THEN 'no credentials claimed' END")} END AS issues,
        {_pairs(has_name=f"CASE WHEN about = 200 AND {_name('abt')} THEN 'true' END", has_contact=f"CASE WHEN about = 200 AND {_any('abt', text.CONTACT)} THEN 'true' END", has_credentials=f"CASE WHEN about = 200 THEN {_any('abt', text.CREDENTIALS)} END")} AS details FROM c)"""


_TEXTS = _complete(_FETCH)
_MARK = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in text.SYMBOLS.items())
_SYMBOL = f"CASE status {_MARK} ELSE '?' END"


def _padded(expr: str, width: int) -> str:
    return f"CASE WHEN length({expr}) < {width} THEN rpad({expr}, {width}, ' ') ELSE {expr} END"


def _clip(expr: str, most: int) -> str:
    return f"CASE WHEN length({expr}) > {most} THEN substr({expr}, 1, {most}) || '...' ELSE {expr} END"


def _check_lines(width: int, of: str) -> str:
    head = f"""{_SYMBOL} || ' ' || {_padded('"check"', width)} || ' | ' || {_padded('status', 10)}"""
    return f"""SELECT site, pos, array_to_string(list_concat([{head}], list_transform(issues, lambda x: '   → ' || x), list_transform(details, lambda e: '   • ' || e.k || ': ' || {_clip('e.v', 60)})), chr(10)) AS lines FROM {of}"""


def _check_reports(title: str, of: str) -> str:
    one = """"check" || ': ' || status || chr(10) || array_to_string(list_transform(issues, lambda x: '  - ' || x || chr(10)), '') || array_to_string(list_transform(details, lambda e: '  ' || e.k || ' = ' || e.v || chr(10)), '')"""
    return f"SELECT site, {_q(title)} || chr(10) || 'Site: ' || site || chr(10) || chr(10) || string_agg({one}, chr(10) ORDER BY pos) AS report FROM {of} GROUP BY site"


def _one_check(name: str) -> str:
    return f"""WITH {_technical(_FETCH)} SELECT site, "check", status, array_to_string(issues, '; ') AS issues FROM checks WHERE "check" = {_q(name)}"""


def _findings(fetch: str) -> str:
    """The findings that SQL can say over a fetch log."""
    act = lambda verdict, action: f"CASE WHEN {verdict} = 'Fail' THEN {_q(action)} ELSE '' END"

    def rows(of: str, id_: str, verdict: str, evidence: str, action: str) -> str:
        return f"SELECT site, {_q(id_)} AS id, v AS verdict, ev AS evidence, {act('v', action)} AS next_action FROM (SELECT site, {verdict} AS v, {evidence} AS ev FROM {of})"

    judged = lambda good, known="true": f"CASE WHEN {known} AND ({good}) THEN 'Pass' WHEN {known} AND NOT ({good}) THEN 'Fail' ELSE 'Unknown' END"
    named = "\"check\" || ': ' || status || CASE WHEN len(issues) > 0 THEN '; ' || array_to_string(issues, '; ') ELSE '' END"
    dead = "len(list_filter(issues, lambda x: starts_with(x, 'homepage gives'))) > 0"
    unread = "len(list_filter(details, lambda x: starts_with(x.v, 'ERROR'))) > 0"
    state = f"CASE WHEN {dead} OR ({unread} AND status = 'OK') THEN 'Unknown' WHEN status = 'OK' THEN 'Pass' WHEN status IN ('FAIL', 'HIGH_RISK') THEN 'Fail' ELSE 'Unknown' END"
    parts = [
        rows("dg", "ADS-CONTENT-01", "CASE WHEN seen > 0 AND thin = seen THEN 'Fail' ELSE 'Unknown' END", "thin || ' of ' || seen || ' pages read are thin'", "write useful pages"),
        rows("dg", "ADS-CONTENT-03", judged("thin = 0", "seen > 0"), "thin || ' of ' || seen || ' pages read are thin'", "extend the thin pages"),
        rows("dg", "ADS-CONTENT-04", judged("vacant = 0", "seen > 0"), "vacant || ' of ' || seen || ' pages read are empty'", "fill the empty pages"),
        rows("dg", "ADS-CRAWL-01", judged("errors = 0"), "errors || ' of ' || n || ' pages fail'", "mend the failing pages"),
        rows("dg", "ADS-COMPLETE-02", judged("guides >= 3", "seen > 0"), "guides || ' substantial guides'", "publish three guides"),
        rows("dg", "ADS-CRAWL-05", judged("keyed = 0"), "keyed || ' of ' || n || ' URLs name a session or a person'", "keep sessions out of URLs"),
        rows("complete", "ADS-COMPLETE-01", state, named, "finish the pages"), rows("complete", "ADS-CONTENT-04", state, named, "finish the pages"),
        rows("identity", "ADS-AUTHOR-01", "CASE WHEN status = 'OK' THEN 'Pass' WHEN status IN ('FAIL', 'HIGH_RISK') THEN 'Fail' ELSE 'Unknown' END", named, "say who publishes"),
        rows("sf", "ADS-TXT-01", f"CASE WHEN NOT published THEN 'N/A' ELSE {judged('network > 0')} END", "CASE WHEN published THEN 'ads.txt has ' || network || ' lines of the ad network' ELSE 'no ads.txt' END", "list the ad network"),
        rows("sf", "ADS-TXT-02", judged("published"), "CASE WHEN published THEN 'ads.txt has ' || direct || ' direct sellers' ELSE 'no ads.txt' END", "publish ads.txt"),
        rows("tp", "ADS-UX-05", "CASE WHEN about IN (404, 410) OR contact IN (404, 410) OR privacy IN (404, 410) THEN 'Fail' WHEN about = 200 AND contact = 200 AND privacy = 200 THEN 'Pass' ELSE 'Unknown' END",
             "'/about ' || coalesce(CAST(about AS VARCHAR), 'not fetched') || ', /contact ' || coalesce(CAST(contact AS VARCHAR), 'not fetched') || ', /privacy ' || coalesce(CAST(privacy AS VARCHAR), 'not fetched')", "publish the trust pages"),
        rows("(SELECT * FROM tp WHERE privacy IS NOT NULL)", "ADS-PRIV-01", "CASE WHEN privacy IN (404, 410) THEN 'Fail' ELSE 'Unknown' END", "'/privacy gives ' || privacy", "publish a privacy policy"),
        rows("tr", "ADS-AUTHOR-02", "CASE WHEN reach THEN 'Pass' WHEN NOT reach THEN 'Fail' ELSE 'Unknown' END", "CASE WHEN reach THEN 'a way of contact is named' WHEN NOT reach THEN 'no way of contact is named' ELSE 'about or contact page not fetched' END", "name a way of contact"),
        rows("tr", "ADS-AUTHOR-03", "CASE WHEN profile THEN 'Pass' WHEN NOT profile THEN 'Fail' ELSE 'Unknown' END", "CASE WHEN profile THEN 'the about page links to a profile' WHEN NOT profile THEN 'the about page links to no profile' ELSE 'about page not fetched' END", "link to a profile"),
    ]
    for id_, check, means, action in policy._CHECKS:
        verdict = f"CASE WHEN status = 'WARNING' AND list_contains(issues, {_q(policy._BLOCKED)}) THEN 'Fail' " + " ".join(f"WHEN status = {_q(k)} THEN {_q(v)}" for k, v in means.items()) + " ELSE 'Unknown' END"
        parts.append(rows(f'(SELECT * FROM checks WHERE "check" = {_q(check)})', id_, verdict, f"{_q(check + ': ')} || status", action))
    good = "error IS NULL AND coalesce(status, 599) < 400"
    line = r"^\s*{0}\s*,\s*[^,\s]+\s*,\s*direct\b"
    listed = "string_split(lower(coalesce(sellers.body, '')), chr(10))"
    return f"""WITH {_technical(fetch)}, {_complete(fetch, more=True)},
df AS (SELECT site, {good} AS good, {words(depth_text("coalesce(body, '')"))} AS w, regexp_matches(requested_url, {_q(urls.SESSION_KEYS)}) AS keyed FROM fetches WHERE method = 'GET'),
dg AS (SELECT site, count(*) AS n, count(*) FILTER (NOT good) AS errors, count(*) FILTER (good) AS seen, count(*) FILTER (good AND w < 300) AS thin, count(*) FILTER (good AND w = 0) AS vacant, count(*) FILTER (good AND w >= 1200) AS guides, count(*) FILTER (keyed) AS keyed FROM df GROUP BY site),
sf AS (SELECT site, sellers.status = 200 AS published, CASE WHEN sellers.status = 200 THEN len(list_filter({listed}, lambda x: regexp_matches(x, {_q(line.format('[^#,\\s]+'))}))) ELSE 0 END AS direct,
       CASE WHEN sellers.status = 200 THEN len(list_filter({listed}, lambda x: regexp_matches(x, {_q(line.format('google\\.com'))}))) ELSE 0 END AS network FROM sellers WHERE error IS NULL AND status IS NOT NULL),
tp AS (SELECT sites.site, CASE WHEN about.error IS NULL THEN about.status END AS about, CASE WHEN contact.error IS NULL THEN contact.status END AS contact, CASE WHEN privacy.error IS NULL THEN privacy.status END AS privacy
       FROM sites LEFT JOIN about USING (site) LEFT JOIN contact USING (site) LEFT JOIN privacy USING (site)),
tr AS (SELECT c.site, CASE WHEN (coalesce(c.about, 0) = 200 AND {_any('abt', text.CONTACT)}) OR (coalesce(c.contact, 0) = 200 AND ({_mail('ct')} OR {_any('ct', text.CONTACT)})) THEN true WHEN coalesce(c.about, 0) IN (200, 404) AND coalesce(c.contact, 0) IN (200, 404) THEN false END AS reach,
       CASE WHEN coalesce(c.about, 0) = 200 THEN regexp_matches(coalesce(about.body, ''), {_q(PROFILE)}) END AS profile FROM c LEFT JOIN about ON about.site = c.site)
{' UNION ALL '.join(parts)}"""


_ORDER = "CASE verdict WHEN 'Fail' THEN 1 WHEN 'Unknown' THEN 2 WHEN 'Pass' THEN 3 ELSE 4 END"
_REPORT = f"""{samples.values_of('findings')}, {_REQ},
worst AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY site, id ORDER BY {_ORDER}) = 1),
base AS (SELECT s.site, r.section, r.id, coalesce(w.severity, r.severity) AS severity,
         CASE WHEN w.verdict IS NULL OR (w.verdict IN ('Pass', 'N/A') AND coalesce(w.evidence, '') = '') THEN 'Unknown' ELSE w.verdict END AS verdict,
         coalesce(w.evidence, '') AS evidence, coalesce(w.next_action, '') AS next_action
  FROM (SELECT DISTINCT site FROM findings) s CROSS JOIN requirements r LEFT JOIN worst w ON w.site = s.site AND w.id = r.id),
broken AS (SELECT DISTINCT site FROM base WHERE section IN ('C', 'D', 'E', 'F', 'G', 'H') AND verdict = 'Fail'),
report AS (SELECT site, section, id, severity, CASE WHEN id = 'ADS-ELIG-03' AND site IN (SELECT site FROM broken) THEN 'Fail' ELSE verdict END AS verdict,
         CASE WHEN id = 'ADS-ELIG-03' AND site IN (SELECT site FROM broken) AND evidence = '' THEN 'a content policy fails' ELSE evidence END AS evidence, next_action FROM base)"""
_READY = """ready AS (SELECT site, count(*) FILTER (severity = 'Blocker' AND verdict = 'Fail') AS blocker_fails, count(*) FILTER (severity = 'High' AND verdict = 'Fail') AS high_fails,
         count(*) FILTER (severity = 'Medium' AND verdict = 'Fail') AS medium_fails, count(*) FILTER (severity = 'Blocker' AND verdict = 'Unknown') AS blocker_unknowns FROM report GROUP BY site)"""
_TASKS = f"""{samples.values_of('work')},
n AS (SELECT *, row_number() OVER (PARTITION BY site, severity ORDER BY effort_hours NULLS LAST, id, evidence) AS no FROM work WHERE verdict = 'Fail'),
tasks AS (SELECT site, CASE severity WHEN 'Blocker' THEN 1 WHEN 'High' THEN 2 ELSE 3 END AS "rank", upper(severity) || '-' || CASE WHEN no < 10 THEN '0' ELSE '' END || no AS seq, id, severity,
         CASE severity WHEN 'Blocker' THEN 'p1' WHEN 'High' THEN 'p2' ELSE 'p3' END AS priority, title, evidence, effort_hours, len(string_split(file_list, ' ')) AS files FROM n)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round(({a}) / ({b})::DOUBLE, 6) END"


def _percent(expr: str) -> str:
    return f"CAST(CAST(round_even({expr} * 100, 0) AS INTEGER) AS VARCHAR) || '%'"


_GROUPS = f"{samples.values_of('alike')}, {samples.values_of('corpus')}, total AS (SELECT site, count(*) AS pages FROM corpus GROUP BY site)"
_CRAWL = """e AS (SELECT n_nationkey AS a, CAST((n_nationkey + 1) % (SELECT count(*) FROM nation) AS BIGINT) AS b FROM nation UNION SELECT n_nationkey, CAST((n_nationkey * 3) % (SELECT count(*) FROM nation) AS BIGINT) FROM nation),
w AS (SELECT CAST(0 AS BIGINT) AS k, 0 AS depth UNION SELECT CAST(2 AS BIGINT), 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.k WHERE w.depth < 2)"""
_URL = "'https://n.example/' || CAST({0} AS VARCHAR)"

SQL: dict[str, str] = {
    "text_depth": _depth("pages", "page_id, url", "html", depth_text("html")),
    "depth_summary_by_site": f"""
WITH {_PAGES}, r AS (SELECT site, {risk('n')} AS risk FROM pg)
SELECT site, count(*) AS total, count(*) FILTER (risk = 'THIN') AS thin, count(*) FILTER (risk = 'BORDERLINE') AS borderline, count(*) FILTER (risk = 'OK') AS ok, count(*) FILTER (risk <> 'OK') AS at_risk FROM r GROUP BY site""",
    "depth_documents": _depth("documents", "doc_id", "text", "text"),
    "depth_lines": f"""
WITH {_PAGES}, r AS (SELECT *, {risk('n')} AS risk FROM pg)
SELECT site, page_id AS seq, CASE WHEN risk = 'OK' THEN '✓ ' ELSE '⚠️ ' END || ' ' || rpad(risk, 12, ' ') || ' | ' || CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, ' ') ELSE CAST(n AS VARCHAR) END || ' words | ' || substr(url, 1, 70) AS line FROM r""",
    "word_band_rollup": f"""
WITH w AS (SELECT lang, {words('text')} AS words FROM documents), r AS (SELECT lang, {risk('words')} AS risk, words FROM w)
SELECT coalesce(lang, 'ALL') AS lang, coalesce(risk, 'ALL') AS risk, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM r GROUP BY ROLLUP (lang, risk)""",
    "depth_reports": f"""
WITH {_PAGES}, r AS (SELECT site, page_id, url, n, {risk('n')} AS risk, length(html) / 1024.0::DOUBLE AS kb FROM pg),
o AS (SELECT site, page_id, url || chr(10) || '  Status: 200' || chr(10) || '  Words: ' || n || ', words/KB: ' || CAST(round(CASE WHEN kb > 0 THEN n / kb ELSE 0.0 END, 2) AS VARCHAR) || chr(10) || '  Risk: ' || risk || chr(10) AS x FROM r)
SELECT site, 'Text depth' || chr(10) || 'Minimum words: 300' || chr(10) || 'Pages: ' || count(*) || chr(10) || chr(10) || string_agg(x, chr(10) ORDER BY page_id, x) AS report FROM o GROUP BY site""",
    "guide_counts": f"WITH {_PAGES} SELECT site, count(*) FILTER (n >= 1200) AS guides FROM pg GROUP BY site",
    "page_metadata": f"""
SELECT page_id, coalesce(nullif({_first('html', 'title')}, ''), '[no title]') AS title,
       coalesce(nullif(trim({_decoded(f"regexp_extract({_DESC}[-1], {_q(html.CONTENT)}, 1)")}), ''), '[none]') AS meta_description,
       coalesce(nullif({_first('html', 'h1')}, ''), '[no h1]') AS h1, CAST(length(html) AS INTEGER) AS content_length FROM pages""",
    "page_links": f"""
WITH l AS (SELECT page_id, {_LINKS} AS links FROM pages)
SELECT page_id, CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos, unnest(links) AS link FROM l""",
    "same_domain_links": f"""
WITH l AS (SELECT page_id, {authority('url')} AS site, unnest({_LINKS}) AS link FROM pages)
SELECT page_id, site, count(*) AS links, count(*) FILTER ((starts_with(link, '/') AND NOT starts_with(link, '//')) OR {authority('link')} = site) AS same_domain FROM l GROUP BY page_id, site""",
    "url_parts": f"""
SELECT page_id, {authority('url')} AS authority, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) || '://' || {authority('url')} AS origin,
       regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, starts_with(url, 'https://') AS https,
       regexp_matches(url, '(?i)[?&](phpsessid|jsessionid|sessionid|session_id|sid|token|email|user)=') AS session_like FROM pages""",
    "https_check": f"""
WITH p AS (SELECT {authority('url')} AS site, starts_with(url, 'https://') AS secure FROM pages)
SELECT site, count(*) AS pages, count(*) FILTER (secure) AS secure_pages, CASE WHEN bool_and(secure) THEN 'OK' ELSE 'WARNING' END AS status FROM p GROUP BY site""",
    "repeated_titles": f"""
WITH p AS (SELECT {authority('url')} AS site, {_first('html', 'title')} AS title FROM pages)
SELECT site, title, count(*) AS pages FROM p GROUP BY site, title HAVING count(*) > 1""",
    "placeholder_scan": f"""
WITH t AS (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'pages', {body_text('html')} FROM pages),
p AS (SELECT unnest([{', '.join(map(_q, text.PLACEHOLDERS))}]) AS phrase)
SELECT source, phrase, count(*) FILTER (contains(lower(text), phrase)) AS n FROM t CROSS JOIN p GROUP BY source, phrase""",
    "identity_signals": f"SELECT doc_id, {_name('text')} AS has_name, {_any('text', text.CONTACT)} AS has_contact, {_any('text', text.CREDENTIALS)} AS has_credentials, {_mail('text')} AS has_email FROM documents",
    "exact_duplicates": "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1",
    "dup_candidates": f"""
WITH c AS (SELECT {authority('url')} AS site, url, arg_min(html, page_id) AS html, min(page_id) AS seq FROM pages GROUP BY url),
t AS (SELECT site, seq, length({dup_text('html')}) AS n FROM c), p AS (SELECT * FROM t WHERE n > 0)
SELECT a.site, a.seq AS i, b.seq AS j FROM p a JOIN p b ON a.site = b.site AND a.seq < b.seq AND 2 * least(a.n, b.n) / (a.n + b.n)::DOUBLE >= 0.8""",
    "benchmark_overlap": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\x0B]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\s\x0B]+'), lambda w: w <> '') AS w FROM benchmark),
dr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM d WHERE len(w) >= 5),
br AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM b WHERE len(w) >= 5),
size AS (SELECT doc_id, count(*) AS n FROM dr GROUP BY doc_id),
hits AS (SELECT doc_id, item_id, count(*) AS common FROM dr JOIN br USING (run) GROUP BY doc_id, item_id),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY common DESC, item_id) = 1)
SELECT doc_id, item_id, round(common / n::DOUBLE, 4) AS overlap, CASE WHEN round(common / n::DOUBLE, 4) < 0.4 THEN 'safe' WHEN round(common / n::DOUBLE, 4) <= 0.6 THEN 'monitor' ELSE 'high' END AS band
FROM best JOIN size USING (doc_id)""",
    "robots_check": _one_check("robots.txt"),
    "headers_check": _one_check("security_headers"),
    "redirect_check": _one_check("redirects"),
    "uptime_check": _one_check("dns_and_uptime"),
    "tls_check": _one_check("https"),
    "sitemap_check": _one_check("sitemap.xml"),
    "technical_checks": f"""
WITH {_technical(_FETCH)}, d AS (SELECT *, array_to_string(list_transform(details, lambda e: e.k || '=' || e.v), '; ') AS shown FROM checks)
SELECT site, pos, "check", {_SYMBOL} AS symbol, status, array_to_string(issues, '; ') AS issues, {_clip('shown', 240)} AS details FROM d""",
    "technical_summary": f"""
WITH {_technical(_FETCH)}, z AS (SELECT site, count(*) FILTER (status IN ('FAIL', 'ERROR')) AS failures, count(*) FILTER (status = 'WARNING') AS warnings FROM checks GROUP BY site)
SELECT *, CASE WHEN failures > 0 THEN failures || ' critical' WHEN warnings > 0 THEN warnings || ' to review' ELSE 'all passed' END AS message FROM z""",
    "technical_lines": f"WITH {_technical(_FETCH)} {_check_lines(20, 'checks')}",
    "technical_reports": f"WITH {_technical(_FETCH)} {_check_reports('Technical checks', 'checks')}",
    "completeness_lines": f"WITH {_TEXTS} {_check_lines(25, '(SELECT * FROM complete UNION ALL SELECT * FROM identity)')}",
    "completeness_reports": f"WITH {_TEXTS} {_check_reports('Completeness checks', '(SELECT * FROM complete UNION ALL SELECT * FROM identity)')}",
    "site_findings": _findings(_pages_as_fetches()),
    "sample_findings": _findings(_FETCH),
    "completeness_check": f"WITH {_TEXTS} SELECT site, \"check\", status, array_to_string(issues, '; ') AS issues FROM complete",
    "identity_check": f"WITH {_TEXTS} SELECT site, \"check\", status, array_to_string(issues, '; ') AS issues FROM identity",
    "completeness_summary": f"""
WITH {_TEXTS}, r AS (SELECT * FROM complete UNION ALL SELECT * FROM identity),
z AS (SELECT site, count(*) FILTER (status IN ('FAIL', 'ERROR')) AS failures, count(*) FILTER (status = 'HIGH_RISK') AS high_risks FROM r GROUP BY site)
SELECT *, CASE WHEN failures > 0 THEN failures || ' failed' WHEN high_risks > 0 THEN high_risks || ' at high risk' ELSE 'all passed' END AS message FROM z""",
    "preflight_gate": f"""
WITH {_TEXTS},
g AS (SELECT site, count(*) FILTER (error IS NULL AND coalesce(status, 599) < 400 AND {words(depth_text("coalesce(body, '')"))} >= 1200) AS guides FROM fetches WHERE method = 'GET' GROUP BY site),
n AS (SELECT c.site, CAST(len(c.issues) AS INTEGER) AS completeness_issues, CAST(len(i.issues) AS INTEGER) AS identity_issues, coalesce(g.guides, 0) AS guides FROM complete c JOIN identity i USING (site) LEFT JOIN g USING (site)),
t AS (SELECT *, CASE WHEN completeness_issues >= 4 THEN 'Blocker' WHEN completeness_issues >= 2 THEN 'High Risk' ELSE 'Pass' END AS completeness_gate,
        CASE WHEN identity_issues >= 1 THEN 'Blocker' ELSE 'Pass' END AS identity_gate, CASE WHEN guides < 3 THEN 'High Risk' ELSE 'Pass' END AS content_gate FROM n),
b AS (SELECT *, CAST(CASE WHEN completeness_gate = 'Blocker' THEN completeness_issues ELSE 0 END + CASE WHEN identity_gate = 'Blocker' THEN identity_issues ELSE 0 END AS INTEGER) AS blockers FROM t)
SELECT *, CASE WHEN blockers = 0 THEN 'full audit' WHEN blockers <= 2 THEN 'fix structure first' ELSE 'appears unfinished' END AS preflight FROM b""",
    "requirement_registry": f"WITH {_REQ} SELECT * FROM requirements",
    "rubric_registry": f"WITH {_RUB} SELECT * FROM rubrics",
    "site_type_rubrics": f"""
WITH {_RUB}, {samples.values('types', registry.SITE_TYPES, 'site_type string, rubric string')}, n AS (SELECT rubric, count(*) AS checks FROM rubrics GROUP BY rubric)
SELECT site_type, types.rubric, coalesce(checks, 0) AS checks FROM types LEFT JOIN n USING (rubric)""",
    "rubric_requirements": f"""
WITH {_RUB}, {_REQ}, {_BEARS}
SELECT b.rubric, b.id, severity, b.check_id, asks FROM bears b JOIN requirements USING (id) LEFT JOIN rubrics r ON r.check_id = b.check_id""",
    "rubric_findings": f"""
WITH {samples.values_of('ratings')}, {_BEARS},
every AS (SELECT rubric, id, count(*) AS checks FROM bears WHERE check_id IS NOT NULL GROUP BY rubric, id),
z AS (SELECT r.site, r.rubric, b.id, count(*) FILTER (NOT passed) AS failed, count(*) AS made FROM ratings r JOIN bears b ON b.rubric = r.rubric AND b.check_id = r.check_id GROUP BY r.site, r.rubric, b.id)
SELECT site, id, CASE WHEN failed > 0 THEN 'Fail' WHEN made = checks THEN 'Pass' ELSE 'Unknown' END AS verdict, made || ' of ' || checks || ' checks made, ' || failed || ' failed' AS evidence FROM z JOIN every USING (rubric, id)""",
    "rejection_priors": f"WITH {samples.values('priors', registry.PRIORS, 'rate int, reason string')} SELECT * FROM priors",
    "severity_rollup": f"WITH {_REQ} SELECT coalesce(section, 'ALL') AS section, coalesce(severity, 'ALL') AS severity, count(*) AS n FROM requirements GROUP BY ROLLUP (section, severity)",
    "checklist": f"WITH {_REPORT} SELECT * FROM report",
    "coverage_gap": f"""
WITH {samples.values_of('findings')}, {_REQ},
every AS (SELECT s.site, r.id FROM (SELECT DISTINCT site FROM findings) s CROSS JOIN requirements r),
miss AS (SELECT site, string_agg(id, ', ' ORDER BY id) AS missing FROM every WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.site = every.site AND f.id = every.id) GROUP BY site)
SELECT f.site, (SELECT count(*) FROM requirements) AS in_reference, count(DISTINCT f.id) AS in_report, coalesce(max(m.missing), 'none') AS missing
FROM findings f LEFT JOIN miss m USING (site) WHERE f.id IN (SELECT id FROM requirements) GROUP BY f.site""",
    "decision": f"""
WITH {_REPORT}, {_READY}
SELECT *, CASE WHEN blocker_fails > 0 THEN 'Not ready' WHEN high_fails + medium_fails + blocker_unknowns > 0 THEN 'Ready after fixes' ELSE 'Ready' END AS decision FROM ready""",
    "audit_report": f"""
WITH {_REPORT}, {_READY},
made AS (SELECT *, CASE WHEN blocker_fails > 0 THEN 'Not ready' WHEN high_fails + medium_fails + blocker_unknowns > 0 THEN 'Ready after fixes' ELSE 'Ready' END AS decision FROM ready),
ln AS (SELECT *, '- `' || id || '`: ' || evidence || '. ' || next_action AS x, '| ' || id || ' | ' || verdict || ' | ' || evidence || ' | ' || next_action || ' |' AS y FROM report),
agg AS (SELECT site, {', '.join(f"coalesce(string_agg(x, chr(10) ORDER BY id, x) FILTER (severity = '{v}' AND verdict = 'Fail'), '') AS {v[0].lower()}" for v in ('Blocker', 'High', 'Medium'))},
        string_agg(y, chr(10) ORDER BY section, id, y) AS t, count(DISTINCT id) AS n FROM ln GROUP BY site)
SELECT site, array_to_string(['**Decision**', decision, '', '**Blockers**', b, '', '**High**', h, '', '**Medium**', m, '', '**Checklist**', '', '| ID | Verdict | Evidence | Next |', '|-|-|-|-|', t, '', '**Coverage**',
       n || ' of ' || (SELECT count(*) FROM requirements) || '; missing: none', ''], chr(10)) AS report FROM agg JOIN made USING (site)""",
    "rejection_map": f"WITH {samples.values_of('messages')}, {_REJ} SELECT message_id, reason_no, theme, id FROM messages JOIN rejections ON regexp_matches(lower(message), pattern)",
    "audit_diff": f"""
WITH {samples.values_of('before')}, {samples.values_of('after')},
j AS (SELECT site, id, b.verdict AS before_v, a.verdict AS after_v FROM before b FULL JOIN after a USING (site, id))
SELECT site, id, before_v AS before, after_v AS after, CASE WHEN before_v IS NULL THEN 'added' WHEN after_v IS NULL THEN 'dropped' WHEN before_v = after_v THEN 'same' WHEN after_v = 'Fail' THEN 'regression'
       WHEN before_v = 'Fail' THEN CASE WHEN after_v = 'Pass' THEN 'fixed' ELSE 'open' END ELSE 'changed' END AS change FROM j""",
    "task_list": f'WITH {_TASKS} SELECT site, "rank", seq, id, severity, priority, title, evidence, effort_hours FROM tasks',
    "task_summary": f"""
WITH {_TASKS}
SELECT site, coalesce(severity, 'TOTAL') AS severity, count(*) AS tasks, CAST(sum(files) AS BIGINT) AS files, sum(effort_hours) AS hours FROM tasks GROUP BY GROUPING SETS ((site, severity), (site))""",
    "task_lines": f"""
WITH {_TASKS}
SELECT site, "rank", seq, '[' || site || '] ' || seq || ': ' || title || ' (' || priority || ', ' || CAST(effort_hours AS VARCHAR) || 'h, @' || lower(severity) || ')' || chr(10) || '- needs: ' || id || chr(10) || '- seen: ' || evidence || chr(10) || '- do: do: ' || title || chr(10) || '- done when: ' || id || ' passes' AS line FROM tasks""",
    "task_issues": f"""
WITH {_TASKS}
SELECT site, "rank", seq, array_to_string(['## [' || site || '] ' || seq || ': ' || title, '', 'Requirement: ' || id, '', 'Evidence: ' || evidence, '', 'Steps:', '- [ ] do: ' || title, '', 'Labels: ' || lower(severity) || ', ' || site], chr(10)) AS issue FROM tasks""",
    "duplicate_lines": f"""
WITH {_GROUPS},
b AS (SELECT site, leader, 'source ' || substr(source, 1, 70) || chr(10) || string_agg('  ↔ ' || {_percent('sim')} || ' | ' || substr(url, 1, 60), chr(10) ORDER BY member) AS x FROM alike GROUP BY site, leader, source),
g AS (SELECT site, string_agg(x, chr(10) ORDER BY leader) AS blocks, count(*) AS n FROM b GROUP BY site)
SELECT site, coalesce(blocks || chr(10), '✓ no similar pages' || chr(10)) || CASE WHEN coalesce(n, 0) > pages * 0.3 THEN '⚠️  duplication is high: ' ELSE '✓ duplication is acceptable: ' END || coalesce(n, 0) || ' groups on ' || pages || ' pages' AS lines FROM total LEFT JOIN g USING (site)""",
    "duplicate_reports": f"""
WITH {_GROUPS},
b AS (SELECT site, leader, 'Source: ' || source || chr(10) || 'Mean: ' || {_percent('avg(sim)')} || chr(10) || string_agg('  ' || {_percent('sim')} || ' | ' || url, chr(10) ORDER BY member) || chr(10) AS x FROM alike GROUP BY site, leader, source),
g AS (SELECT site, string_agg(x, chr(10) ORDER BY leader) AS blocks, count(*) AS n FROM b GROUP BY site)
SELECT site, array_to_string(['Similar pages', 'Threshold: 0.8', 'Pages: ' || pages, 'Groups: ' || coalesce(n, 0), '', ''], chr(10)) || coalesce(blocks, '') AS report FROM total LEFT JOIN g USING (site)""",
    "repeated_text": f"""
WITH f AS (SELECT {authority('url')} AS site, url, arg_min(html, page_id) AS html, min(page_id) AS seq FROM pages GROUP BY url),
t AS (SELECT site, seq, {dup_text('html')} AS txt FROM f), u AS (SELECT site, seq, unnest(string_split(txt, chr(10))) AS chunk FROM t WHERE txt <> ''),
o AS (SELECT site, chunk, count(DISTINCT seq) AS on_pages FROM u GROUP BY site, chunk),
s AS (SELECT site, seq, sum(CASE WHEN on_pages > 1 THEN length(chunk) ELSE 0 END) / sum(length(chunk)) AS share FROM u JOIN o USING (site, chunk) GROUP BY site, seq),
z AS (SELECT site, count(*) AS pages, round(avg(share), 4) AS shared_text FROM s GROUP BY site)
SELECT *, CASE WHEN shared_text <= 0.3 THEN 'Pass' WHEN shared_text >= 0.5 THEN 'Fail' ELSE 'Unknown' END AS verdict FROM z""",
    "rubric_checks": f"""
WITH p AS (SELECT page_id, {words(depth_text('html'))} AS n, {authority('url')} AS site, url, html, {_LINKS} AS links,
        coalesce(trim({_decoded(f"regexp_extract({_DESC}[-1], {_q(html.CONTENT)}, 1)")}), '') AS about, {_first('html', 'title')} AS title, {_first('html', 'h1')} AS h1 FROM pages),
c AS (SELECT page_id, unnest(['TOOL-02', 'TOOL-06', 'TOOL-11', 'TOOL-12', 'TOOL-13', 'QUIZ-09', 'QUIZ-15']) AS check_id, unnest([n >= 300,
        len(list_filter(links, lambda x: (starts_with(x, '/') AND NOT starts_with(x, '//')) OR (site <> '' AND {authority('x')} = site))) >= 1,
        NOT regexp_matches(url, '(?i)[?&](phpsessid|jsessionid|sessionid|session_id|sid|token|email|user)='), length(about) BETWEEN 100 AND 160, length(title) >= 10 AND length(h1) >= 3, n >= 200,
        regexp_matches(html, {_q(html.CANONICAL)})]) AS passed FROM p)
SELECT page_id, check_id, coalesce(passed, false) AS passed FROM c""",
    "rubric_rate": f"""
WITH {samples.values_of('ratings')},
r AS (SELECT site, rubric, count(*) AS checks, round(avg(CAST(passed AS DOUBLE)), 4) AS pass_rate, max(overlap) AS overlap FROM ratings GROUP BY site, rubric)
SELECT *, CASE WHEN (rubric = 'quiz' AND pass_rate >= 0.7 AND coalesce(overlap, 0) < 0.4) OR (rubric <> 'quiz' AND pass_rate >= 0.8) THEN 'Pass' WHEN pass_rate < 0.5 THEN 'Fail' ELSE 'Unknown' END AS verdict FROM r""",
    "accuracy_metrics": f"""
WITH j AS (SELECT {words('text')} < 300 AS flagged, quality = 0 AS rejected FROM documents JOIN labels USING (doc_id)),
n AS (SELECT count(*) FILTER (flagged AND rejected) AS flagged_rejected, count(*) FILTER (NOT flagged AND rejected) AS passed_rejected, count(*) FILTER (flagged AND NOT rejected) AS flagged_approved, count(*) FILTER (NOT flagged AND NOT rejected) AS passed_approved FROM j)
SELECT *, {_ratio('flagged_rejected + passed_approved', 'flagged_rejected + passed_rejected + flagged_approved + passed_approved')} AS accuracy,
       {_ratio('flagged_rejected', 'flagged_rejected + passed_rejected')} AS tp_share_of_rejected, {_ratio('flagged_rejected', 'flagged_rejected + flagged_approved')} AS tp_share_of_flagged FROM n""",
    "crawl_bfs": f"""
WITH RECURSIVE {_CRAWL} SELECT {_URL.format('k')} AS url, min(depth) AS depth FROM w GROUP BY k""",
    "crawl_lines": f"""
WITH RECURSIVE {_CRAWL}, u AS (SELECT DISTINCT k, {_URL.format('k')} AS url FROM w)
SELECT 'n.example' AS site, url, '  200 | ' || rpad(substr(url, 1, 70), 70, ' ') || ' | Page ' || k AS line FROM u""",
}
