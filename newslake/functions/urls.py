"""Canonical URLs, hashes of them, domains and feed guesses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslake.functions import lexicon as lx
from newslake.functions.base import ColumnOrName, any_of, blank_to_null, col, contains_any, strip, strings, text

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _decode(part: Column) -> Column:
    return F.when(part.rlike("[%+]"), F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))).otherwise(part)


def _encode(part: Column) -> Column:
    """Form encoding that keeps ``~`` and escapes ``*``."""
    enc = F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(part.rlike("[^A-Za-z0-9_.~-]"), enc).otherwise(part)


def canonical_query(query: Column) -> Column:
    """Drop tracking parameters, then sort the decoded pairs and encode them again."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.startswith(F.lower(p["k"]), F.lit(lx.TRACKING_PREFIX)) & ~F.lower(p["k"]).isin(lx.TRACKING_KEYS),
    )
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def normalize_url(url: ColumnOrName) -> Column:
    """Canonical form: lower scheme and host, no default port, tracking, fragment or final slash."""
    raw = F.translate(strip(text(url)), "\t\r\n", "")
    scheme = F.lower(F.regexp_extract(raw, _URL, 1))
    host = F.lower(F.regexp_extract(raw, _URL, 2))
    path = F.regexp_extract(raw, _URL, 3)
    query = F.regexp_extract(raw, _URL, 4)
    host = (
        F.when(scheme == "http", F.regexp_replace(host, ":80$", ""))
        .when(scheme == "https", F.regexp_replace(host, ":443$", ""))
        .otherwise(host)
    )
    path = F.when(path == "/", path).otherwise(F.rtrim(path, F.lit("/")))
    query = F.when(query == "", query).otherwise(canonical_query(query))
    path = F.when((host != "") & (path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def url_hash(url: ColumnOrName) -> Column:
    return F.sha2(normalize_url(url), 256)


def authority(url: ColumnOrName) -> Column:
    return F.regexp_extract(text(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def item_domain(domain: ColumnOrName | None, url: ColumnOrName) -> Column:
    """Stored domain, else the host of the URL, else ``unknown``."""
    host = F.lower(authority(url))
    from_url = F.when(host != "", host).otherwise(F.lit("unknown"))
    if domain is None:
        return from_url
    return F.coalesce(F.when(col(domain) != "", F.lower(col(domain))), from_url)


def absolute_url(href: Column, base: ColumnOrName) -> Column:
    """Resolve a link that starts with ``/`` against the page it stands on."""
    root = F.concat(F.regexp_extract(col(base), r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), F.lit("//"), authority(base))
    return (
        F.when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(col(base), r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .otherwise(href)
    )


def url_date(url: ColumnOrName) -> Column:
    """Date written in the path as /20yy/mm/dd/, null if there is none or it is not a date."""
    stamp = F.regexp_extract(text(url), r"/(20\d{2}/\d{2}/\d{2})/", 1)
    return F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyy/MM/dd")).cast("date")


def category_by_url(url: ColumnOrName, broad: bool = False, default: Column | None = None) -> Column:
    """Region before city, by markers in the address."""
    low = F.lower(text(url))
    region = lx.REGION_URL_MARKERS_BROAD if broad else lx.REGION_URL_MARKERS_STRICT
    city = lx.MOSCOW_URL_MARKERS_BROAD if broad else lx.MOSCOW_URL_MARKERS_STRICT
    return (
        F.when(contains_any(low, region), F.lit("moscow_region"))
        .when(contains_any(low, city), F.lit("moscow"))
        .otherwise(default if default is not None else F.lit(None).cast("string"))
    )


def skips_article_fetch(source: ColumnOrName, url: ColumnOrName, domains: list[str] | None = None) -> Column:
    target = F.lower(F.concat_ws(" ", text(source), text(url)))
    return target.rlike(any_of(domains or lx.NO_ARTICLE_FETCH))


def feed_candidates(url: ColumnOrName) -> Column:
    """Usual feed addresses of a site; empty for blocked hosts and non-URLs."""
    scheme = F.regexp_extract(text(url), r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    host = authority(url)
    base = F.concat(F.lower(scheme), F.lit("://"), host)
    usable = (scheme != "") & (host != "") & ~F.lower(host).isin(lx.FEED_GUESS_BLOCKLIST)
    return F.when(usable, F.transform(strings(lx.FEED_SUFFIXES), lambda s: F.concat(base, s))).otherwise(
        F.array().cast("array<string>")
    )


def normalize_bases(bases: Column) -> Column:
    """Clean mirror roots: https by default, no final slash, blanks and repeats dropped."""
    clean = F.transform(F.filter(bases, lambda b: blank_to_null(b).isNotNull()), strip)
    full = F.transform(clean, lambda b: F.when(F.startswith(b, F.lit("http")), b).otherwise(F.concat(F.lit("https://"), b)))
    return F.array_distinct(F.transform(full, lambda b: F.rtrim(b, F.lit("/"))))


def mirror_urls(url: ColumnOrName, bases: Column) -> Column:
    """The same path on the other mirror roots; empty if the URL is under none of them."""
    own = F.try_element_at(F.filter(bases, lambda b: F.startswith(col(url), b)), F.lit(1))
    others = F.filter(bases, lambda b: b != own)
    path = F.substring(col(url), F.length(own) + 1, F.length(col(url)))
    return F.when(own.isNotNull(), F.transform(others, lambda b: F.concat(b, path))).otherwise(F.array().cast("array<string>"))
