"""HTML by native columns: text profiles, metadata, links. ``exact`` has the parser's own reading.

Three text profiles are kept apart, since they disagree:

* ``depth``: all text but that of script, style, nav, footer and noscript; chunks joined by spaces.
* ``dup``: the same, chunks of three characters or more, joined by newlines.
* ``body``: the text within ``<body>``, scripts included.

Native profiles squeeze white space; they equal the parser's for pages whose skipped elements balance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED = ("script", "style", "nav", "footer", "noscript")
TAG = r"<[a-zA-Z/!?][^>]*(>|\z)"
COMMENT = r"(?s)<!--.*?(-->|\z)"
#: Only the entities that pages use most; ``exact`` knows them all. The ampersand comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}
PREFIX = 5000


def skip_pattern(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\z)"


def decode(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def squeezed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def _bare(body: Column) -> Column:
    return squeezed(decode(F.regexp_replace(body, TAG, " ")))


def depth_text(body: Column) -> Column:
    body = F.regexp_replace(body, COMMENT, " ")
    for tag in SKIPPED:
        body = F.regexp_replace(body, skip_pattern(tag), " ")
    return _bare(body)


def dup_text(body: Column) -> Column:
    """Chunks of three characters or more, one a line."""
    body = F.regexp_replace(body, COMMENT, " ")
    for tag in SKIPPED:
        body = F.regexp_replace(body, skip_pattern(tag), "\x01")
    chunks = F.transform(F.split(F.regexp_replace(body, TAG, "\x01"), "\x01"), lambda x: F.btrim(decode(x), F.lit(" \t\n\r\x0b\x0c")))
    return F.array_join(F.filter(chunks, lambda x: F.length(x) > 2), "\n")


def body_text(body: Column) -> Column:
    inner = F.regexp_extract(body, r"(?is)<body\b[^>]*>(.*?)(</body\s*>|\z)", 1)
    return _bare(F.regexp_replace(inner, COMMENT, " "))


def _all(html: Column, tag: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), 1)
    return F.btrim(decode(F.regexp_replace(F.array_join(found, ""), r"<[^>]*>", "")))


def head(html: Column) -> Column:
    """What metadata is read from: the page's first characters."""
    return F.substring(html, 1, PREFIX)


def title(html: Column) -> Column:
    """All titles run together, as a parser that only appends gives them."""
    return _all(head(html), "title")


def h1(html: Column) -> Column:
    return _all(head(html), "h1")


META = r"(?is)<meta\b[^>]*\bname\s*=\s*[\"']description[\"'][^>]*>"
CONTENT = r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']"


def description(html: Column) -> Column:
    """The last description within the head."""
    inner = F.regexp_extract(head(html), r"(?is)<head\b[^>]*>(.*?)(</head\s*>|\z)", 1)
    tags = F.regexp_extract_all(inner, F.lit(META), 0)
    return F.coalesce(F.btrim(decode(F.regexp_extract(F.try_element_at(tags, F.lit(-1)), CONTENT, 1))), F.lit(""))


def or_else(text: Column, other: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(other))


LINK = "href=[\"']([^\"']+)[\"']"


def links(body: Column) -> Column:
    """Every href, of whatever element, but for those within the page."""
    return F.filter(F.regexp_extract_all(body, F.lit(LINK), 1), lambda x: ~F.startswith(x, F.lit("#")))


CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']canonical[\"']"


def has_canonical(body: Column) -> Column:
    return F.rlike(body, F.lit(CANONICAL))
