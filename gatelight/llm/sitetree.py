"""HTML extraction with site style trees.

The pages of a host are merged into one tree. An element node is a place in it: the parent's place, the
sequence of children that the parent has on the page (its style), and the child's position in that
sequence. Pages that are built alike at a place share the node. Text beside elements is a ``#text``
child. Importance follows from entropy over the m pages that share a node, in units of log m:

* A leaf's content importance is 1 - the mean entropy of its features. Features are the sentences of
  its text, its link and its source; a feature's entropy is that of its spread over the pages, so what
  every page repeats has entropy 1 and what one page holds alone has 0. The unit is log(min(m, ``support``)),
  so that a template repeated on some of a host's pages goes however many pages the host has: with the
  defaults, what stands on five pages or more in the (geometric) mean of a place's features.
* An inner node's presentation importance is the entropy of the pages' distribution over its styles.
* Its composite importance is (1 - g^l) * presentation + g^l * the mean, over its styles by their share
  of pages, of the children's mean composite importance; l is the number of its styles, g ``damp``.
* A node that fewer than ``min_pages`` pages share has importance 1.

A branch goes when its node and all nodes below it have a composite importance under ``least``; each
page then loses its uppermost such branches. The rest, as text, is the result.

Nothing is gathered by host: nodes, styles and features are keyed by hashes that begin with the host, and
all statistics are sums, so a host of any size spreads over the cluster. Composite importance is
computed level by level, deepest first, over the shared nodes only.

* Host: the URL's authority in lower case. A null or odd URL is the host ''.
* Pages of a host with the same html count as one page for the tree; each is still reported.
* A null or blank html gives an empty text and no branches. Broken HTML is parsed leniently: void
  elements, unclosed elements (closed by their parent, or by what may not stand in them), stray end tags
  and cut-off pages. Comments, declarations, script, style, template and noscript are no content.
* Elements more than ``depth`` levels down count as text of the element at that level.
* Rows that share a page_id are each reported. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize
from .tables import field

LEAST, DAMP, MIN_PAGES, DEPTH = 0.3, 0.9, 3, 64
#: A feature on so many pages has the entropy of a template, on a host of any size.
SUPPORT = 8
#: Branches to remove are broadcast up to so many; beyond that they are joined by page.
BROADCAST_ROWS = 2_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "template", "noscript", "textarea")}
_SILENT = {"script", "style", "template", "noscript"}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul br".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_FENCE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
#: A slash that ends a tag by itself, and isn't the end of a bare value.
_SELF = re.compile(r"(?:^|[\s\"'])/$")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")


class Node:
    """An element or a text run; ``sign`` is what it looks like to its parent's style."""

    __slots__ = ("tag", "attrs", "kids", "text", "sign")

    def __init__(self, tag: str, attrs: str = "", text: str = "") -> None:
        self.tag, self.attrs, self.text, self.kids = tag, attrs, text, []
        look = _attr(attrs).get("class", "") if "class" in attrs or "CLASS" in attrs else ""
        self.sign = f"{tag} {' '.join(sorted(look.split()))}" if look else tag


def parse(html: str, depth: int = DEPTH) -> Node:
    """The page's tree; text runs are ``#text`` nodes."""
    root = Node("#root")
    stack = [root]
    over: list[str] = []  # open elements below the last level
    at, end = 0, len(html)
    match = _TOKEN.match
    while at < end:
        m = match(html, at)
        at = m.end()
        close, tag, attrs = m.groups()
        if tag is None:
            run = m.group()
            if run.startswith(("<!", "<?")):
                continue
            if not run.isspace():
                kids = stack[-1].kids
                if kids and kids[-1].tag == "#text":
                    kids[-1].text += entities.unescape(run)
                else:
                    kids.append(Node("#text", "", entities.unescape(run)))
            continue
        tag = tag.lower()
        if close:
            if tag in over:
                while over.pop() != tag:
                    pass
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    over.clear()
                    break
            continue
        if tag in _RAW:
            stop = _RAW[tag].search(html, at)
            body = html[at : stop.start()] if stop else html[at:]
            at = stop.end() if stop else end
            if tag not in _SILENT and body.strip():
                stack[-1].kids.append(Node("#text", "", entities.unescape(body)))
            continue
        if tag in _BLOCK and tag != "br" and not over:
            for i in range(len(stack) - 1, 0, -1):  # a block element ends an open paragraph
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "li", "div", "button"):
                    break
        if tag in _CLOSES and not over:
            fence, cut = _FENCE[tag], len(stack)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in fence:
                    break
                if stack[i].tag in _CLOSES[tag]:
                    cut = i  # a row closes with the cell that is open within it
            del stack[cut:]
        if tag == "br":
            kids = stack[-1].kids
            if kids and kids[-1].tag == "#text":
                kids[-1].text += "\n"
            continue
        if tag in _VOID:
            stack[-1].kids.append(Node(tag, attrs))
            continue
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if not _SELF.search(attrs):
            if len(stack) <= depth and not over:
                stack.append(node)
            else:
                over.append(tag)
    return root


def _attr(attrs: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if "=" in attrs else {}


def _h(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def features(node: Node, up: Node | None) -> list[str]:
    """What a leaf says: its sentences, its link or that of the element around it, its source."""
    own = _attr(node.attrs) if node.attrs else {}
    out = [f"{k} {own[k]}" for k in ("href", "src", "alt", "value") if own.get(k)]
    for one in _SENTENCE.split(_said(node)):
        if bare := " ".join(one.split()):
            out.append(bare)
    if node.tag == "#text" and up is not None and up.tag == "a" and (link := _attr(up.attrs).get("href")):
        out.append(f"href {link}")
    return out


def _said(node: Node) -> str:
    """A leaf's text: its own, or that of its only text child."""
    return node.text if node.tag == "#text" else node.kids[0].text if node.kids else ""


def _leaf(node: Node) -> bool:
    return not node.kids or len(node.kids) == 1 and node.kids[0].tag == "#text"


def _style(node: Node) -> int:
    return _h("style", *[k.sign for k in node.kids]) or 1


def walk(root: Node, host: str) -> Iterator[tuple[Node, Node | None, int, int, int, int, int]]:
    """Each node, its parent node, key, parent's key, level, siblings with itself, own style (0: a leaf)."""
    stack = [(root, None, _h("host", host), 0, 0, 1)]
    while stack:
        node, up, key, above, level, many = stack.pop()
        if node.tag != "#root" and _leaf(node):
            yield node, up, key, above, level, many, 0
            continue
        style = _style(node)
        yield node, up, key, above, level, many, style
        for i, kid in enumerate(node.kids):
            stack.append((kid, node, _h(key, style, i), key, level + 1, len(node.kids)))


def kept(root: Node, host: str, noisy: set[int]) -> tuple[str, int, int]:
    """The page's text without the branches in ``noisy`` (signed keys), how many went, and how many nodes stay."""
    out: list[str] = []
    gone = stay = 0
    todo: list = [(root, _h("host", host))]
    while todo:
        node, key = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        if _signed(key) in noisy:
            gone += 1
            continue
        stay += 1
        block = node.tag in _BLOCK
        if block:
            out.append("\n")
        if node.tag != "#root" and _leaf(node):
            out.append(_said(node))
            if block:
                out.append("\n")
            continue
        if block:
            todo.append(("\n", 0))
        style = _style(node)
        for i, kid in reversed(list(enumerate(node.kids))):
            todo.append((kid, _h(key, style, i)))
    lines = [" ".join(x.split()) for x in "".join(out).split("\n")]
    return "\n".join(x for x in lines if x), gone, stay


_SUMS = {"e": "long", "s": "long", "is_feature": "boolean", "up": "long", "level": "int", "many": "int", "n": "double", "nlogn": "double"}
_HELD = 200_000


def _flush(held: dict[tuple[int, int, bool], list]) -> pa.RecordBatch:
    e, s, kind = zip(*held)
    up, level, many, n, nlogn = zip(*held.values())
    longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (e, s, up)]
    return pa.RecordBatch.from_arrays([longs[0], longs[1], pa.array(kind), longs[2], pa.array(level, pa.int32()), pa.array(many, pa.int32()), pa.array(n), pa.array(nlogn)], list(_SUMS))


def _counted(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """From host, html and copies: sums for the nodes' styles and features, added up within the task."""
    held: dict[tuple[int, int, bool], list] = {}
    for batch in batches:
        for host, html, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if not html or html.isspace():
                continue
            weight = 1.0 / copies
            for node, up, key, above, level, many, style in walk(parse(html, depth), host):
                own = held.setdefault((key, style, False), [above, level, many, 0.0, 0.0])
                own[3] += weight
                if not style:
                    seen: dict[str, int] = {}
                    for f in features(node, up):
                        seen[f] = seen.get(f, 0) + 1
                    for f, times in seen.items():
                        own = held.setdefault((key, xxhash.xxh3_64_intdigest(f), True), [0, 0, 0, 0.0, 0.0])
                        own[3] += weight * times
                        if times > 1:
                            own[4] += weight * times * math.log(times)
            if len(held) > _HELD:
                yield _flush(held)
                held = {}
    if held:
        yield _flush(held)


def own_pages(pages: DataFrame) -> DataFrame:
    """page_id, host, html, and a fingerprint of host and html."""
    host = F.coalesce(F.lower(F.try_parse_url(field("url").cast("string"), F.lit("AUTHORITY"))), F.lit(""))
    own = pages.select(field("page_id").alias("page_id"), host.alias("host"), field("html").cast("string").alias("html"))
    return own.withColumn("fp", F.xxhash64("host", "html"))


def nodes(own: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row for each node of the style trees: its sums over the pages."""
    twice = materialize(own.groupBy("fp").agg(F.count("*").alias("copies")).where("copies > 1"))
    weighed = own.join(twice, "fp", "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    sums = weighed.mapInArrow(lambda it: _counted(it, depth), ", ".join(f"{k} {v}" for k, v in _SUMS.items()))
    each = sums.groupBy("e", "s", "is_feature").agg(F.max("up").alias("up"), F.max("level").alias("level"), F.max("many").alias("many"), F.round(F.sum("n"), 6).alias("n"), F.round(F.sum("nlogn"), 6).alias("nlogn"))
    styled, feature = ~F.col("is_feature"), F.col("is_feature")
    spread = F.round(F.log("n") - F.col("nlogn") / F.col("n"), 9)
    return each.groupBy("e").agg(
        F.max(F.when(styled, F.col("up"))).alias("up"), F.max("level").alias("level"), F.max("many").alias("many"), F.round(F.sum(F.when(styled, F.col("n"))), 5).alias("m"),
        F.sum(F.when(styled, F.round(F.col("n") * F.log("n"), 9))).alias("mlogm"), F.count(F.when(styled & (F.col("s") != 0), 1)).alias("styles"),
        F.count(F.when(feature, 1)).alias("features"), F.sum(F.when(feature, spread)).alias("spread"))


def branches(own: DataFrame, least: float = LEAST, damp: float = DAMP, min_pages: int = MIN_PAGES, depth: int = DEPTH, support: int = SUPPORT) -> DataFrame:
    """e: the uppermost nodes of the branches that go."""
    shared = nodes(own, depth).where((F.col("m") >= min_pages) & (F.col("m") > 1))
    unit = F.log("m")
    present = F.greatest(F.lit(0.0), (unit - F.col("mlogm") / F.col("m")) / unit)
    content = F.when(F.col("features") > 0, F.lit(1.0) - F.col("spread") / F.col("features") / F.least(unit, F.lit(math.log(support)))).otherwise(F.lit(0.0))
    weight = F.pow(F.lit(float(damp)), F.col("styles"))
    shared = materialize(shared.select("e", "up", "level", "many", "m", "styles", present.alias("present"), content.alias("content"), weight.alias("weight")), "level")
    deepest = shared.agg(F.max("level")).first()[0]
    done = []
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = shared.where(F.col("level") == level)
        if done:
            # a child has a share of 1 / many in each page that has it; those that few pages share have importance 1
            own_share = F.col("m") / F.col("many")
            kids = done[-1].groupBy(F.col("up").alias("parent")).agg(F.sum(F.col("importance") * own_share).alias("known"), F.sum(own_share).alias("share"), F.min("quiet").alias("quiet_below"))
            here = here.join(kids, here.e == kids.parent, "left")
        else:
            here = here.select("*", F.lit(None).cast("double").alias("known"), F.lit(None).cast("double").alias("share"), F.lit(None).cast("boolean").alias("quiet_below"))
        rest = F.col("m") - F.coalesce("share", F.lit(0.0))
        inner = (1 - F.col("weight")) * F.col("present") + F.col("weight") * (F.coalesce("known", F.lit(0.0)) + rest) / F.col("m")
        here = here.withColumn("importance", F.round(F.when(F.col("styles") == 0, F.col("content")).otherwise(inner), 6))
        below = (F.col("styles") == 0) | ((rest < 1e-4 * F.col("m")) & F.coalesce("quiet_below", F.lit(False)))
        done.append(materialize(here.select("e", "up", "many", "m", "importance", ((F.col("importance") < least) & below).alias("quiet"))))
    if not done:
        return shared.select("e").limit(0)
    quiet = done[0]
    for x in done[1:]:
        quiet = quiet.unionByName(x)
    quiet = quiet.where("quiet").select("e", "up")
    return quiet.join(quiet.select(F.col("e").alias("up")), "up", "left_anti").select("e")


_OUT = "text string, removed_branches int, kept_nodes int"


def _cleaned(rows: Iterator[tuple], depth: int) -> tuple[list, list, list]:
    """From host, html and the keys to remove."""
    out: tuple[list, list, list] = ([], [], [])
    for host, html, noisy in rows:
        one = kept(parse(html, depth), host, noisy) if html and not html.isspace() else ("", 0, 0)
        for col, x in zip(out, one):
            col.append(x)
    return out


def _table(ids: pa.Array, found: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(found[0], pa.string()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.int32())], ["page_id", "text", "removed_branches", "kept_nodes"])


def extract(spark: SparkSession, pages: DataFrame, least: float = LEAST, damp: float = DAMP, min_pages: int = MIN_PAGES, depth: int = DEPTH, broadcast_rows: int = BROADCAST_ROWS, support: int = SUPPORT) -> DataFrame:
    """page_id, text of what stays, removed_branches and kept_nodes, for every page."""
    own = own_pages(pages)
    gone = materialize(branches(own, least, damp, min_pages, depth, support))
    kind = pages.schema["page_id"].dataType.simpleString()
    if gone.count() <= broadcast_rows:
        shared = spark.sparkContext.broadcast(np.sort(gone.toArrow().column("e").to_numpy()))

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            noisy = set(shared.value.tolist())
            for batch in batches:
                host, html = (c.to_pylist() for c in batch.columns[1:])
                yield _table(batch.column(0), _cleaned(((a, b, noisy) for a, b in zip(host, html)), depth))

        return own.select("page_id", "host", "html").mapInArrow(clean, f"page_id {kind}, {_OUT}")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, e = [], []
            for f, host, html in zip(*(c.to_pylist() for c in batch.columns)):
                if html and not html.isspace():
                    found = [_signed(x[2]) for x in walk(parse(html, depth), host)]
                    fp += [f] * len(found)
                    e += found
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(e, pa.int64())], ["fp", "e"])

    # too many to broadcast: each page meets its own by its fingerprint
    mine = own.select("fp", "host", "html").mapInArrow(keys, "fp long, e long").join(gone, "e", "left_semi").groupBy("fp").agg(F.collect_set("e").alias("noisy"))

    def clean_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, html, noisy = (c.to_pylist() for c in batch.columns[1:])
            yield _table(batch.column(0), _cleaned(((a, b, set(c or ())) for a, b, c in zip(host, html, noisy)), depth))

    return own.join(mine, "fp", "left").select("page_id", "host", "html", "noisy").mapInArrow(clean_own, f"page_id {kind}, {_OUT}")
