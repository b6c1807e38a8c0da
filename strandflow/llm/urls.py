"""Canonical URLs and host names as column expressions (the same text runs as SQL elsewhere)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
# Fixed parameter names that don't change what a page shows
TRACKING = r"(^|&)(ref|sid|sessionid|fbclid|gclid|utm_[a-z]+)=[^&]*"


def host(url: Column) -> Column:
    """Lower-case host without user, default port and a leading www. or m.; '' where there is none."""
    h = F.lower(F.regexp_extract(url, SCHEME + r"([^/?#]*)", 1))
    h = F.regexp_replace(F.regexp_replace(h, r"^.*@", ""), r":(80|443)$", "")
    return F.regexp_replace(h, r"^(www|m)\.", "")


def canonical(url: Column) -> Column:
    """Host, path without slashes at its end, and the query without tracking parameters; no scheme, no fragment."""
    u = F.regexp_replace(url, r"#.*$", "")
    path = F.regexp_replace(F.regexp_extract(u, SCHEME + r"[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"\?(.*)$", 1), TRACKING, ""), r"^&", "")
    return F.concat(host(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


HOST_SQL = r"""regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^(www|m)\.', '')"""
CANONICAL_SQL = (
    HOST_SQL
    + r""" || regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '(^|&)(ref|sid|sessionid|fbclid|gclid|utm_[a-z]+)=[^&]*', '', 'g'), '^&', '') <> ''
       THEN '?' || regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '(^|&)(ref|sid|sessionid|fbclid|gclid|utm_[a-z]+)=[^&]*', '', 'g'), '^&', '') ELSE '' END"""
)
