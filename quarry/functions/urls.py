"""URL column functions (FN-16, FIL-3/5/6, TXT-7).

Parts are taken with one regular expression (RFC 3986 appendix B), which is
total on any string, unlike ``parse_url`` that returns NULL on malformed input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: RFC 3986 appendix B URI pattern.
URI_PATTERN = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
TRACKING_PARAM = r"(^|&)utm_[^&]*"
HOST_PREFIX = r"^(www|m)\."


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), URI_PATTERN, 2))


def host(url) -> Column:
    """Lower-cased host without user info or port."""
    auth = F.regexp_extract(_c(url), URI_PATTERN, 4)
    return F.lower(F.regexp_replace(F.regexp_replace(auth, r"^.*@", ""), r":[0-9]*$", ""))


def path(url) -> Column:
    return F.regexp_extract(_c(url), URI_PATTERN, 5)


def query(url) -> Column:
    return F.regexp_extract(_c(url), URI_PATTERN, 7)


def fragment(url) -> Column:
    return F.regexp_extract(_c(url), URI_PATTERN, 9)


def canonical_url(url) -> Column:
    """TXT-7 option: host without ``www.``/``m.``, path without trailing slash,
    tracking (``utm_*``) parameters and fragment removed; scheme dropped."""
    q = F.regexp_replace(F.regexp_replace(query(url), TRACKING_PARAM, ""), r"^&", "")
    p = F.regexp_replace(path(url), r"/+$", "")
    base = F.concat(F.regexp_replace(host(url), HOST_PREFIX, ""), p)
    return F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q))


def host_matches(url, domains: list[str]) -> Column:
    """FIL-3: host equals a domain or ends with ``.domain``; empty list = true."""
    if not domains:
        return F.lit(True)
    h = host(url)
    cond = F.lit(False)
    for d in domains:
        d = d.lower()
        cond = cond | (h == F.lit(d)) | h.endswith("." + d)
    return cond


def site_filter(url, site: str, path_prefix: str | None = None) -> Column:
    """FIL-6: pages of one site (host or sub-host), optionally under a path."""
    cond = host_matches(url, [site])
    if path_prefix:
        cond = cond & path(url).startswith(path_prefix)
    return cond
