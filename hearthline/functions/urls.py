"""Hosts and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-cased host without port and user; null for what is no absolute URL. Hosts that the parser refuses (international names) are cut out by pattern."""
    plain = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)", 1)
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.nullif(plain, F.lit(""))))


def root_domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def same_or_below(domain: Column, base: Column) -> Column:
    return (domain == base) | F.endswith(domain, F.concat(F.lit("."), base))


def safe_site_url(url: Column, site: str) -> Column:
    """The URL if it is http(s) on the site's host or below it, else null."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when(scheme.isin("http", "https") & same_or_below(host(url), F.lit(site)), url)


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^\s/?#]+"), F.lit(False))


def absolutize(href: Column, base: Column) -> Column:
    """An href resolved against the URL of its page; null if it is empty, a fragment, or of another scheme."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.concat(origin, F.coalesce(F.nullif(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*/|/)", 1), F.lit("")), F.lit("/")))
    h = F.btrim(href)
    return (
        F.when(h.rlike(r"(?i)^https?://"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h))
        .when(F.startswith(h, F.lit("/")), F.concat(origin, h))
        .when((h == "") | F.startswith(h, F.lit("#")) | h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(folder, h))
    )
