"""Parts of URLs. The authority keeps port and user, which the host would drop."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"
#: Query keys that name a session or a person.
SESSION_KEYS = r"(?i)[?&](phpsessid|jsessionid|sessionid|session_id|sid|token|email|user)="


def authority(url: Column) -> Column:
    """'' where there is none, as with relative URLs."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def is_https(url: Column) -> Column:
    return F.startswith(url, F.lit("https://"))


def session_like(url: Column) -> Column:
    return F.rlike(url, F.lit(SESSION_KEYS))
