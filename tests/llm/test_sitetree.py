import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gatelight.llm import sitetree as st


def brute(pages, least=st.LEAST, damp=st.DAMP, min_pages=st.MIN_PAGES):
    """The tree as nested dictionaries, host by host: page -> text."""
    roots = defaultdict(dict)
    for host, html in pages:
        if html and html.strip():
            roots[host][html] = st.parse(html)
    noisy = {}
    for host, trees in roots.items():
        places = defaultdict(list)  # path -> [(page, node, parent)]

        def visit(page, node, up, path, places=places):
            places[path].append((page, node, up))
            if path == () or not st._leaf(node):
                style = tuple(k.sign for k in node.kids)
                for i, kid in enumerate(node.kids):
                    visit(page, kid, node, (*path, (style, i)))

        for page, root in trees.items():
            visit(page, root, None, ())
        memo = {}

        def importance(path, places=places, memo=memo):
            if path in memo:
                return memo[path]
            own = places[path]
            m = len(own)
            if m < min_pages or m == 1:
                memo[path] = (1.0, False)
                return memo[path]
            styles = defaultdict(int)
            for _, node, _up in own:
                leaf = path != () and st._leaf(node)
                styles[None if leaf else tuple(k.sign for k in node.kids)] += 1
            inner = {s: n for s, n in styles.items() if s is not None}
            if not inner:
                where = defaultdict(lambda: defaultdict(int))
                for page, node, up in own:
                    for f in st.features(node, up):
                        where[f][page] += 1
                h = [-sum(n / sum(w.values()) * math.log(n / sum(w.values())) for n in w.values()) / math.log(m) for w in where.values()]
                value = 1 - sum(h) / len(h) if h else 0.0
                memo[path] = (value, value < least)
                return memo[path]
            spread = -sum(n / m * math.log(n / m) for n in styles.values()) / math.log(m)
            below, quiet = 0.0, True
            for s, n in styles.items():
                if s is None:
                    below += n / m  # pages on which the place is a leaf have no children
                    quiet = False
                    continue
                kids = [importance((*path, (s, i))) for i in range(len(s))]
                below += n / m * (sum(k for k, _ in kids) / len(kids) if kids else 1.0)
                quiet = quiet and bool(kids) and all(q for _, q in kids)
            weight = damp ** len(inner)
            value = (1 - weight) * spread + weight * below
            memo[path] = (value, value < least and quiet)
            return memo[path]

        for path in list(places):
            importance(path)
        noisy[host] = {p for p, (_, q) in memo.items() if q}

    def text(host, html):
        if not html or not html.strip():
            return ""
        lines = []

        def say(node, path):
            if path in noisy[host]:
                return
            block = node.tag in st._BLOCK
            if block:
                lines.append("\n")
            if path != () and st._leaf(node):
                lines.append(st._said(node))
            else:
                style = tuple(k.sign for k in node.kids)
                for i, kid in enumerate(node.kids):
                    say(kid, (*path, (style, i)))
            if block:
                lines.append("\n")

        say(st.parse(html), ())
        return "\n".join(x for x in (" ".join(y.split()) for y in "".join(lines).split("\n")) if x)

    return [text(h, x) for h, x in pages]


def page(k, body, foot="All rights reserved."):
    links = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("home", "news", "about"))
    return f"<html><head><title>Title {k}</title><script>x()</script></head><body><nav class='m'><ul>{links}</ul></nav><div class=main>{body}</div><footer>{foot}</footer></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://one.example/{k}", page(k, f"<h1>Story {k}</h1><p>Unique text number {k}. It tells of {k * 7}.</p>" + "<p>more " + str(k) + "</p>" * (k % 2))) for k in range(8)]
    rows += [(20 + k, "http://ONE.example/copy", rows[3][2]) for k in range(6)]  # copies don't make content common
    rows += [(30, "http://two.example/", page(1, "<p>alone</p>")), (31, None, page(2, "<p>no host</p>")), (32, "http://one.example/e", ""), (33, "http://one.example/n", None), (None, "not a url", "<p>cut <b>off"), (34, "http://one.example/w", "  \n ")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("e", F.lit(1))


def test_equals_brute_force(spark, pages):
    own = st.own_pages(pages).collect()
    want = sorted((str(r.page_id), x) for r, x in zip(own, brute([(r.host, r.html) for r in own])))
    got = st.extract(spark, pages).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == want
    one = {r.page_id: r for r in got}
    assert "All rights" not in one[1].text and "home" not in one[1].text and "Unique text number 1." in one[1].text
    assert "Unique text number 3." in one[20].text  # a copied page keeps its content
    assert "All rights" in one[30].text and one[33].text == "" and one[34].text == "" and one[None].text == "cut off"
    joined = st.extract(spark, pages, broadcast_rows=-1).collect()
    assert sorted(map(str, got)) == sorted(map(str, joined))


def test_stored_pages(spark, small):
    table = spark.read.parquet(f"{small}/pages.parquet")
    own = st.own_pages(table).collect()
    want = sorted((r.page_id, x) for r, x in zip(own, brute([(r.host, r.html) for r in own])))
    assert sorted((r.page_id, r.text) for r in st.extract(spark, table).collect()) == want


def test_empty(spark, pages):
    assert st.extract(spark, pages.limit(0)).count() == 0


def test_parser():
    tree = st.parse("<ul><li>a<li>b</ul><p>x<p>y<div>z</div></b><table><tr><td>1<td>2<tr><td>3</table><img src=q><!-- c --><textarea>t<b></textarea>")
    show = lambda n: n.text if n.tag == "#text" else f"{n.tag}({' '.join(map(show, n.kids))})"
    assert show(tree) == "#root(ul(li(a) li(b)) p(x) p(y) div(z) table(tr(td(1) td(2)) tr(td(3))) img() t<b>)"
    deep = "<div>" * 5000 + "bottom" + "</div>" * 5000
    assert "bottom" in st.kept(st.parse(deep), "h", set())[0]
    assert st.kept(st.parse("a < b & c &amp; d"), "h", set())[0] == "a < b & c & d"


def test_sections_of_a_large_host(spark):
    """Each of 50 sections repeats its own footer on 6 of 300 pages."""
    rows = [(k, f"http://big.example/{k}", page(k, f"<p>Unique text number {k}.</p>", f"Footer of section {k % 50}.")) for k in range(300)]
    got = st.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Title {k}\nUnique text number {k}." for k in range(300)}


def xml_tree(text):
    """(tag, class words, children) by an XML parser; text runs as strings."""
    from xml.etree import ElementTree

    def one(e):
        kids = [e.text] if (e.text or "").strip() else []
        for kid in e:
            kids.append(one(kid))
            if (kid.tail or "").strip():
                kids.append(kid.tail)
        return e.tag, sorted(e.get("class", "").split()), kids

    return one(ElementTree.fromstring(text))


def own_tree(node):
    return node.text if node.tag == "#text" else (node.tag, sorted(node.sign.split()[1:]), [own_tree(k) for k in node.kids])


def test_parser_against_an_xml_parser():
    """Well-formed pages give the tree that an XML parser gives."""
    import random

    rng = random.Random(12)

    def made(level):
        if level > 5 or rng.random() < 0.3:
            return f"text {rng.randrange(99)} &amp; more"
        tag = rng.choice(["div", "section", "span", "em", "article", "b"])
        look = rng.choice(["", " class='a'", ' class="b a"', ' id="x" class="c"'])
        return f"<{tag}{look}>" + "".join(made(level + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(60):
        page = f"<html><body>{''.join(made(0) for _ in range(4))}<img src='x.png'/><hr/></body></html>"
        joined = lambda t: t if isinstance(t, str) else (t[0], t[1], [joined(k) for k in merged(t[2])])

        def merged(kids):
            out = []
            for k in kids:
                if isinstance(k, str) and out and isinstance(out[-1], str):
                    out[-1] += k
                else:
                    out.append(k)
            return out

        assert joined(own_tree(st.parse(page).kids[0])) == joined(xml_tree(page))


def test_slashes_and_depth():
    a = st.parse("<a href=/>home</a><a href=http://x/>away</a><div class='k'/>after")
    assert [k.tag for k in a.kids] == ["a", "a", "div", "#text"] and [k.kids[0].text for k in a.kids[:2]] == ["home", "away"]
    # elements below the last level end without ending those above
    page = "<div>" * 3 + "<p><b>deep</b></p>" + "</div>" * 3 + "<em>next</em>"
    got = st.parse(page, depth=3)
    assert [k.tag for k in got.kids] == ["div", "em"]
