"""A live source: ``spark.read.format("gatelight_http").option("urls", path).load()`` fetches a URL list.

Each partition keeps one connection pool's worth of work to itself and waits ``delay`` seconds between
requests. The result is a fetches table; write it once and check the copy. Options: ``method`` (GET, HEAD, or
HEAD-DIRECT, which doesn't follow redirects), ``agent``, ``timeout``, ``delay``, ``per_partition``.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.technical import DIRECT
from .fetches import FETCHES

#: As a browser, for pages; as a robot that says so, for the technical checks.
AGENT = "Mozilla/5.0 (compatible; gatelight/1.0)"
ROBOT = "gatelight-robot/1.0"


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, follow: bool) -> None:
        self.count, self.follow = 0, follow

    def redirect_request(self, *args):
        if not self.follow:
            return None  # the redirect itself is the answer
        self.count += 1
        return super().redirect_request(*args)


def fetch(url: str, method: str = "GET", timeout: float = 10.0, seq: int = 0, agent: str = AGENT) -> tuple:
    """One row of fetches. Nothing is raised: a failure is a row with an error. HEAD-DIRECT is a HEAD without redirects."""
    hops = _Redirects(method != DIRECT)
    opener = urllib.request.build_opener(hops)
    began = time.monotonic()
    site, ssl_error, kind = urlsplit(url).netloc, False, None
    try:
        try:
            answer = opener.open(urllib.request.Request(url, method="HEAD" if method == DIRECT else method, headers={"User-Agent": agent}), timeout=timeout)
        except urllib.error.HTTPError as e:
            answer = e
        took = round((time.monotonic() - began) * 1000, 2)
        body = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        return site, url, answer.geturl(), method, answer.status, body, dict(answer.headers.items()), hops.count, took, False, None, None, seq
    except Exception as e:  # noqa: BLE001 - recorded
        ssl_error = "SSL" in repr(e)
        kind = "ssl" if ssl_error else "connection" if isinstance(e, (urllib.error.URLError, OSError)) else "other"
        return site, url, None, method, None, None, {}, hops.count, None, ssl_error, kind, str(e), seq


class _Urls(InputPartition):
    def __init__(self, urls: list[tuple[int, str]]) -> None:
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[_Urls]:
        with open(self.options["urls"], encoding="utf-8") as f:
            urls = [x.strip() for x in f if x.strip() and not x.startswith("#")]
        step = int(self.options.get("per_partition", 100))
        return [_Urls(list(enumerate(urls))[i : i + step]) for i in range(0, len(urls), step)] or [_Urls([])]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for seq, url in partition.urls:
            yield fetch(url, self.options.get("method", "GET"), float(self.options.get("timeout", 10)), seq, self.options.get("agent", AGENT))
            time.sleep(float(self.options.get("delay", 0)))


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gatelight_http"

    def schema(self) -> str:
        return FETCHES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
