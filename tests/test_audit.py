"""The audit's operators on hand-made rows: known quirks, edges, and differential tests against plain Python."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gatelight.functions import exact, html, text
from gatelight.operators import completeness, crawl, depth, duplicates, metrics, policy, rubric, technical
from gatelight.plans import modes, registry, samples
from gatelight.sources import fetches as src


@pytest.fixture(scope="module")
def fetched(spark):
    return samples.fetches(spark)


def page(spark, *bodies, urls=None, status=200, error=None):
    rows = [("s", u, u, "GET", status, b, None, 0, 1.0, False, None, error, i) for i, (b, u) in enumerate(zip(bodies, urls or [f"https://s/{k}" for k in range(len(bodies))]))]
    return spark.createDataFrame(rows, src.FETCHES)


def test_native_text_equals_the_parser(spark, small):
    pages = src.read_table(spark, small, "pages")
    both = pages.select(html.depth_text(F.col("html")).alias("a"), exact.exact_text("depth")("html").alias("b"), html.body_text(F.col("html")).alias("c"), exact.exact_text("body")("html").alias("d"), html.title(F.col("html")).alias("t"), html.h1(F.col("html")).alias("h"), "html").collect()
    for r in both:
        assert r.a.split() == r.b.split() and r.c.split() == r.d.split()
        title, _, h1 = exact.meta_of(r.html)
        assert (r.t, r.h) == (title, h1)


def test_profiles(spark):
    body = "<html><head><meta charset=x><title>T</title></head><body><p>one two</p><p>ab</p><script>todo()</script></body></html>"
    assert exact.text_of(body, "dup_compat") == ""  # the void element hides the rest
    assert exact.text_of(body, "dup") == "one two"
    assert exact.text_of(body.replace("<meta charset=x>", "<meta charset=x />"), "dup_compat") == "one two"
    assert exact.text_of("<p>no body</p>", "body") == ""
    assert "todo()" in exact.text_of(body, "body")
    assert exact.meta_of("<head><title>a</title><meta name=Description content=' d '></head><title>b</title>") == ("ab", "d", "")
    got = spark.createDataFrame([(body,)], "b string").select(html.dup_text(F.col("b")).alias("x")).first().x
    assert got == "one two"


@pytest.mark.parametrize(("n", "want"), [(299, "THIN"), (300, "BORDERLINE"), (449, "BORDERLINE"), (450, "OK")])
def test_risk_bounds(spark, n, want):
    row = depth.page_depth(page(spark, "<p>" + "w " * n + "</p>")).first()
    assert (row.word_count, row.risk) == (n, want)


def test_failed_pages_count_as_ok(spark):
    found = depth.page_depth(page(spark, "x", None, status=500))
    assert {r.risk for r in found.collect()} == {"ERROR"}
    assert depth.summary(found, "site").first().asDict() == {"site": "s", "total": 2, "thin": 0, "borderline": 0, "ok": 2, "at_risk": 0}
    assert "Risk: ERROR" in depth.report(found).first().report


def greedy(n, edges):
    done, out = set(), {}
    for i in range(n):
        if i in done:
            continue
        own = [j for j in range(n) if j != i and j not in done and (i, j) in edges]
        done |= {i, *own}
        out |= dict.fromkeys(own, i)
    return out


def test_leaders_equal_the_greedy_loop(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(3)
    edges, want = [], {}
    for g in range(40):
        n = rng.randint(2, 14)
        own = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.25}
        edges += [(str(g), i, j) for i, j in own]
        want |= {(str(g), m): lead for m, lead in greedy(n, own).items()}
    got = duplicates.leaders(None, spark.createDataFrame(edges, "site string, i long, j long")).collect()
    assert {(r.site, r.member): r.leader for r in got} == want


def test_similar_pairs_lose_none(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(1, 30))) for _ in range(12)]
    texts = base + [t[: int(len(t) * rng.uniform(0.6, 1))] + "zz" for t in base] + ["", "x"]
    rows = [("s", i, f"u{i}", t, len(t)) for i, t in enumerate(texts) if t]
    pages = spark.createDataFrame(rows, "site string, seq long, url string, text string, n int")
    got = {(r.i, r.j): r.sim for r in duplicates.similar_pairs(pages, 0.7).collect()}
    want = {(a[1], b[1]): s for a in rows for b in rows if a[1] < b[1] and (s := SequenceMatcher(None, a[3], b[3]).ratio()) >= 0.7}
    assert got == want and want


def test_robots(spark):
    def status(body, code=200, rfc=False):
        rows = page(spark, body, urls=["https://s/robots.txt"], status=code)
        return technical.checks(rows, rfc).where("check = 'robots.txt'").first().status

    assert status("User-agent: *\nDisallow: /admin") == "FAIL"  # any path does
    assert status("User-agent: *\nDisallow: /admin", rfc=True) == "OK"
    assert status("User-agent: *\nDisallow: /", rfc=True) == "FAIL"
    assert status("User-agent: *\nDisallow: /\nUser-agent: Mediapartners-Google\nAllow: /") == "WARNING"  # overwrites
    assert status("", 404) == "MISSING"


def test_missing_is_no_warning(fetched):
    found = technical.checks(fetched)
    one = {r.site: r for r in technical.summary(found).collect()}
    assert one["good.example"].message == "all passed"
    state = {(r.site, r.check): r.status for r in found.collect()}
    assert state["unfinished.example", "sitemap.xml"] == "MISSING" and state["slow.example", "dns_and_uptime"] == "WARNING"
    assert state["blocked.example", "redirects"] == "FAIL" and state["gone.example", "dns_and_uptime"] == "FAIL" and state["badcert.example", "https"] == "FAIL"
    assert state["anonymous.example", "sitemap.xml"] == "WARNING"


def test_scenarios(fetched):
    found = {(r.site, r.check): r for r in completeness.checks(fetched).collect()}
    assert found["good.example", "site_completeness"].status == found["good.example", "publisher_identity"].status == "OK"
    bad = found["unfinished.example", "site_completeness"]
    assert bad.status == "HIGH_RISK" and len(bad.issues) == 3
    assert found["unfinished.example", "publisher_identity"].status == "FAIL"
    assert found["anonymous.example", "publisher_identity"].status == "HIGH_RISK"
    assert found["slow.example", "site_completeness"].issues == ["homepage gives 503"]
    gate = {r.site: r for r in completeness.gates(completeness.checks(fetched), completeness.guides(depth.page_depth(fetched))).collect()}
    assert gate["good.example"].preflight == "full audit" and gate["unfinished.example"].identity_gate == "Blocker"


def test_phrases(spark):
    df = spark.createDataFrame([("Coming SOON, a drafty todo",)], "t string")
    assert df.select(text.found_phrases(F.col("t"), text.PLACEHOLDERS)).first()[0] == ["coming soon", "draft", "todo"]
    assert df.select(text.found_phrases(F.col("t"), text.PLACEHOLDERS, strict=True)).first()[0] == ["coming soon", "todo"]


def test_registry_is_whole():
    ids = [r[1] for r in registry.REQUIREMENTS]
    assert len(ids) == len(set(ids)) == 81
    severity = [r[2] for r in registry.REQUIREMENTS]
    assert (severity.count("Blocker"), severity.count("High"), severity.count("Medium")) == (35, 35, 11)
    assert len(registry.RUBRICS) == 33 and sum(r for r, _ in registry.PRIORS) == 100
    assert {r[3] for r in registry.REJECTIONS} <= set(ids)


def test_every_requirement_once(spark, fetched):
    out = modes.audit(spark, fetched)
    n = out["checklist"].groupBy("site").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert {(r.n, r.d) for r in n} == {(81, 81)}
    verdict = {(r.site, r.id): r.verdict for r in out["checklist"].collect()}
    assert verdict["good.example", "ADS-CRAWL-02"] == "Pass" and verdict["blocked.example", "ADS-CRAWL-02"] == "Fail"
    assert verdict["good.example", "ADS-PUB-15"] == "Unknown"
    assert {r.missing for r in out["coverage"].collect()} == {"none"}
    assert {r.site: r.decision for r in out["decision"].collect()}["unfinished.example"] == "Not ready"


def test_audit_judges_duplication(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(2, 9) for _ in range(80)) for _ in range(8)]
    alike = page(spark, *[f"<p>{t} {end}</p>" for t in texts[:4] for end in ("one", "two")])  # 4 groups of 8 pages
    apart = page(spark, *[f"<p>{t}</p>" for t in texts], urls=[f"https://t/{k}" for k in range(8)]).withColumn("site", F.lit("t"))
    got = {(r.site, r.id): r for r in modes.audit(spark, alike.union(apart))["checklist"].collect()}
    assert (got["s", "ADS-CONTENT-08"].verdict, got["s", "ADS-CONTENT-08"].evidence) == ("Fail", "8 of 8 pages in groups")
    assert got["t", "ADS-CONTENT-08"].verdict == "Pass"


def test_rates_and_bands(spark):
    got = {r.site: r.verdict for r in rubric.rated(samples.sample(spark, "ratings")).collect()}
    assert got == {"tool0.example": "Pass", "tool1.example": "Unknown", "tool2.example": "Fail", "quiz3.example": "Pass", "quiz4.example": "Unknown", "quiz5.example": "Fail"}
    band = spark.createDataFrame([(0.39,), (0.4,), (0.6,), (0.61,)], "x double").select(duplicates.overlap_band(F.col("x"))).collect()
    assert [r[0] for r in band] == ["safe", "monitor", "monitor", "high"]


def test_metrics(spark):
    cases = [(True, True)] * 8 + [(False, True)] + [(True, False)] * 2 + [(False, False)] * 9
    row = metrics.accuracy(spark.createDataFrame(cases, "flagged boolean, rejected boolean")).first()
    assert row.accuracy == 0.85 and math.isclose(row.tp_share_of_rejected, 8 / 9, abs_tol=1e-6) and row.tp_share_of_flagged == 0.8


def test_crawl(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    urls = ["https://s/", "https://s/a", "https://s/a#x", "https://s/b", "https://s/c"]
    bodies = ['<title>A</title><a href="/a"></a><a href="/a#x"></a><a href="#top"></a><a href="https://off/"></a>', '<link href="/b">', "", '<a href="/c">', "deep"]
    starts = spark.createDataFrame([("s", "https://s/")], "site string, url string")
    got = {r.url: r for r in crawl.crawl(page(spark, *bodies, urls=urls), starts, 2).collect()}
    assert {u: r.depth for u, r in got.items()} == {"https://s/": 0, "https://s/a": 1, "https://s/a#x": 1, "https://s/b": 2}
    assert got["https://s/"].title == "A" and got["https://s/b"].title == "[no title]"
    records = crawl.crawl(page(spark, *bodies, urls=urls), starts, 2).withColumn("seq", F.col("depth").cast("long"))
    src.write_crawl(records, "https://s/", "2026-01-01", str(tmp_path / "crawl"))
    back = src.crawl_file(spark, str(tmp_path / "crawl"))
    assert src.crawled_urls(back).count() == 4 and back.first().start_url == "https://s/"


def test_url_list(spark, tmp_path):
    (tmp_path / "u.txt").write_text("https://a/\n\n# no\nhttps://b/\n")
    assert [r.url for r in src.url_list(spark, str(tmp_path / "u.txt")).collect()] == ["https://a/", "https://b/"]


def test_live_source(spark, tmp_path):
    import http.server
    import threading

    from gatelight.sources.live import HttpSource

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(302 if self.path == "/old" else 404 if self.path == "/none" else 200)
            if self.path == "/old":
                self.send_header("Location", "/new")
            self.end_headers()
            self.wfile.write(b"<p>hello</p>")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    (tmp_path / "u.txt").write_text(f"{base}/old\n{base}/none\nhttp://127.0.0.1:1/\n")
    spark.dataSource.register(HttpSource)
    got = {r.requested_url: r for r in spark.read.format("gatelight_http").option("urls", str(tmp_path / "u.txt")).load().collect()}
    server.shutdown()
    assert got[f"{base}/old"].final_url == f"{base}/new" and got[f"{base}/old"].redirect_count == 1
    assert got[f"{base}/none"].status == 404 and got["http://127.0.0.1:1/"].error_kind == "connection"


def test_streaming_health(spark, tmp_path):
    from gatelight.streaming import health

    rows = page(spark, "<p>x</p>", "<p>y</p>").withColumn("fetched_at", F.to_timestamp(F.lit("2026-01-01 10:05:00")))
    rows.union(rows).write.parquet(str(tmp_path / "in"))
    stream = health.health(health.incoming(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("health").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select * from health").collect()
    assert [(r.fetches, r.failures, r.thin) for r in got] == [(2, 0, 2)]  # repeated rows count once


def test_diff(spark):
    got = {(r.site, r.id): r.change for r in policy.diff(samples.sample(spark, "before"), samples.sample(spark, "after")).collect()}
    assert got["a.example", "ADS-CONTENT-02"] == "fixed" and got["a.example", "ADS-UX-05"] == "regression" and got["b.example", "ADS-CRAWL-02"] == "open"


def test_groups_and_risk(spark):
    rows = [("s", i, f"u{i}", t, len(t)) for i, t in enumerate(["abcdefghij", "abcdefghiX", "qqqqqqqqqq", "abcdefghYX"])]
    pages = spark.createDataFrame(rows, "site string, seq long, url string, text string, n int")
    found = duplicates.groups(pages, duplicates.similar_pairs(pages))
    got = found.collect()
    assert [(r.source, [(p.url, p.sim) for p in r.similar_pages], r.avg_similarity) for r in got] == [("u0", [("u1", 0.9), ("u3", 0.8)], pytest.approx(0.85))]
    risk = duplicates.risk(pages, found).first()
    assert (risk.pages, risk.groups, risk.affected, risk.affected_share, risk.duplication) == (4, 1, 3, 0.75, "acceptable")
    alone = duplicates.risk(pages.where("seq < 2"), found).first()
    assert alone.duplication == "high"


def test_texts(spark):
    from gatelight import queries

    report = {r.site: r.report for r in queries.audit_report(spark, "").collect()}
    assert report["a.example"].startswith("**Decision**\nNot ready\n") and "- `ADS-CONTENT-02`: 40 of 50 pages alike. write own text" in report["a.example"]
    assert report["b.example"].count("| ADS-") == 81 and "81 of 81; missing: none" in report["b.example"]
    lines = {(r.site, r.seq): r.line for r in queries.task_lines(spark, "").collect()}
    assert lines["a.example", "BLOCKER-01"] == "[a.example] BLOCKER-01: Name the publisher (p1, 1.5h, @blocker)\n- needs: ADS-AUTHOR-01\n- seen: no name\n- do: do: Name the publisher\n- done when: ADS-AUTHOR-01 passes"
    issues = {(r.site, r.seq): r.issue for r in queries.task_issues(spark, "").collect()}
    assert "- [ ] do: Ask for consent" in issues["b.example", "HIGH-02"] and issues["b.example", "HIGH-02"].endswith("Labels: high, b.example")


def test_all_pages_against_the_plain_loop(spark, small):
    """Near-duplicates and their groups over all stored pages, against a loop over pairs; its bounds are the library's own."""
    from gatelight import queries

    pages = src.read_table(spark, small, "pages").orderBy("page_id").collect()
    seen = {}
    for r in pages:
        seen.setdefault(r.url, (r.page_id, exact.text_of(r.html, "dup")))
    texts = sorted(v for v in seen.values() if v[1])
    want = {}
    for k, (i, a) in enumerate(texts):
        for j, b in texts[k + 1 :]:
            m = SequenceMatcher(None, a, b)
            if m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 and (s := m.ratio()) >= 0.8:
                want[i, j] = s
    assert {(r.i, r.j): r.sim for r in queries.near_duplicates(spark, small).collect()} == want and want
    place = {i: k for k, (i, _) in enumerate(texts)}
    lead = greedy(len(texts), {(place[i], place[j]) for i, j in want})
    groups = {}
    for member, leader in lead.items():
        groups.setdefault(leader, []).append(member)
    url = {v[0]: u for u, v in seen.items()}
    got = {r.source: [p.url for p in r.similar_pages] for r in queries.duplicate_groups(spark, small).collect()}
    assert got == {url[texts[g][0]]: [url[texts[m][0]] for m in sorted(ms)] for g, ms in groups.items()}


def test_lcs_stops_early_only_when_out_of_reach():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 300))) for _ in range(2))
        whole = exact.lcs(a, b)
        assert exact.lcs(a, b, whole) == whole and exact.lcs(a, b, whole + 1) <= whole


def test_what_was_not_fetched_is_unknown(spark):
    """Stored pages without robots.txt, sitemap, headers and trust pages: nothing is said of those."""
    rows = src.from_pages(spark.createDataFrame([(1, "https://s/", "<body><p>" + "word " * 400 + "</p></body>"), (2, "https://s/a?sid=1", "<body></body>")], "page_id long, url string, html string"))
    got = {r.id: r for r in modes.audit(spark, rows)["checklist"].collect()}
    unknown = ["ADS-CRAWL-02", "ADS-CRAWL-04", "ADS-CRAWL-07", "ADS-TXT-01", "ADS-TXT-02", "ADS-PRIV-01", "ADS-UX-05", "ADS-AUTHOR-01", "ADS-AUTHOR-02", "ADS-AUTHOR-03", "ADS-COMPLETE-01", "ADS-CONTENT-OVERLAP", "ADS-CONTENT-02", "ADS-PUB-01"]
    assert {i: got[i].verdict for i in unknown} == dict.fromkeys(unknown, "Unknown")
    assert got["ADS-CRAWL-05"].verdict == "Fail" and got["ADS-CRAWL-05"].evidence == "1 of 2 URLs name a session or a person"
    assert got["ADS-CONTENT-04"].verdict == "Fail" and got["ADS-CRAWL-01"].verdict == "Pass" and got["ADS-ELIG-03"].verdict == "Fail"


def test_findings_of_each_kind(spark):
    from gatelight.operators.technical import DIRECT

    def rows(site, **bodies):
        paths = {"home": "/", "about": "/about", "contact": "/contact", "privacy": "/privacy", "ads": "/ads.txt", "robots": "/robots.txt"}
        return [(site, f"https://{site}{paths[k]}", f"https://{site}{paths[k]}", "GET", code, body, {}, 0, 10.0, False, None, None, i) for i, (k, (code, body)) in enumerate(bodies.items())]

    long = "word " * 400
    made = rows("a", home=(200, f"<body>{long}</body>"), about=(200, f"<body>Jane Miller, engineer, contact me {long}<a href='https://github.com/jane'></a></body>"), contact=(200, "<body>me@a</body>"), privacy=(200, "<body>all</body>"), ads=(200, "google.com, pub-1, DIRECT, f08\nother.com, 2, RESELLER"), robots=(404, ""))
    made += rows("b", home=(200, f"<body>{long}</body>"), about=(404, ""), contact=(404, ""), privacy=(404, ""), ads=(200, "other.com, 2, DIRECT"), robots=(200, "User-agent: *\nDisallow: /"))
    made += rows("c", home=(200, f"<body>{long}</body>"), ads=(404, ""))
    made += [("a", "https://a/", "https://a/", DIRECT, 301, None, {"X-Frame-Options": "DENY"}, 0, 5.0, False, None, None, 9), ("a", "https://a/", "https://a/x", "HEAD", 200, None, {}, 3, 5.0, False, None, None, 10)]
    others = spark.createDataFrame([(7, long)], "id long, text string")
    fetched = spark.createDataFrame(made, src.FETCHES)
    got = {(r.site, r.id): r.verdict for r in modes.audit(spark, fetched, others=others)["checklist"].collect()}
    want = {
        "ADS-TXT-01": ("Pass", "Fail", "N/A"), "ADS-TXT-02": ("Pass", "Pass", "Fail"), "ADS-UX-05": ("Pass", "Fail", "Unknown"), "ADS-PRIV-01": ("Unknown", "Fail", "Unknown"), "ADS-AUTHOR-02": ("Pass", "Fail", "Unknown"),
        "ADS-AUTHOR-03": ("Pass", "Unknown", "Unknown"), "ADS-CRAWL-02": ("Pass", "Fail", "Unknown"), "ADS-CRAWL-04": ("Fail", "Pass", "Pass"), "ADS-CONTENT-OVERLAP": ("Fail", "Fail", "Fail"),
    }
    assert {i: tuple(got[s, i] for s in "abc") for i in want} == want
    own = {(r.site, r.check): r for r in technical.checks(fetched).collect()}
    assert "Clickjacking protection" in own["a", "security_headers"].details  # of the answer itself, not of the target
    assert own["a", "redirects"].details["redirect_count"] == "3"


def test_repo_and_live(spark):
    bad, good = (page(spark, f"<p>{t}</p>") for t in ("", "word " * 400))
    got = {r.id: r.change for r in modes.repo_and_live(spark, good, bad).collect()}
    assert got["ADS-CONTENT-03"] == "regression" and "ADS-PUB-01" not in got


def test_repeated_share(spark):
    rows = [("s", 1, "menu of it\nown text"), ("s", 2, "menu of it\nmenu of it\nother"), ("s", 3, "alone here"), ("t", 1, "menu of it")]
    got = {r.site: (r.pages, r.shared_text) for r in duplicates.repeated_share(spark.createDataFrame(rows, "site string, seq long, text string")).collect()}
    assert got == {"s": (3, round((10 / 18 + 20 / 25 + 0) / 3, 4)), "t": (1, 0.0)}
    verdicts = {(r.site, r.check_id): r.verdict for r in rubric.site_checks(spark.createDataFrame([("s", 0.6)], "site string, shared_text double"), spark.createDataFrame([("s", 0.1)], "site string, overlap double")).collect()}
    assert verdicts == {("s", "QUIZ-18"): "Fail", ("s", "QUIZ-19"): "Pass"}


def test_percent_and_padding(spark):
    got = spark.createDataFrame([(0.125,), (0.135,), (0.995,), (1.0,)], "x double").select(text.percent(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{x:.0%}" for x in (0.125, 0.135, 0.995, 1.0)]


def test_crawl_of_two_sites(spark, tmp_path):
    rows = [(s, k, f"https://{s}/{k}", 200, "t", "d", "h", 1, 0, None) for s in ("a", "b") for k in range(2)]
    records = spark.createDataFrame(rows, "site string, seq long, url string, status int, title string, meta_description string, h1 string, content_length int, depth int, error string")
    src.write_crawl(records, None, "2026-01-01", str(tmp_path / "two"))
    back = src.crawl_file(spark, str(tmp_path / "two"), lines=True).collect()
    assert sorted((r.start_url, r.url) for r in back) == sorted((f"https://{s}/", f"https://{s}/{k}") for s in ("a", "b") for k in range(2))
