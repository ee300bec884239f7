"""Publication dates: parsing, UTC normalisation, date text in the project zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslake.functions import lexicon as lx
from newslake.functions.base import ColumnOrName, col, let, lookup, strip, text

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
_RFC = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})?)\s*([A-Za-z]{1,4}|[+-]\d{4})?$"
# Zone abbreviations of mail dates.
_RFC_ZONES = {
    "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def to_utc(local: Column, zone: str) -> Column:
    """A naive local time of the project zone as a UTC instant."""
    return local if zone == "UTC" else F.to_utc_timestamp(local, zone)


def to_project(ts: ColumnOrName, zone: str = "UTC") -> Column:
    return col(ts) if zone == "UTC" else F.from_utc_timestamp(col(ts), zone)


def parse_datetime(value: ColumnOrName, zone: str = "UTC") -> Column:
    """Date text → UTC timestamp: ISO, mail dates, dotted dates; null for anything else.

    Text without an offset is taken in the project ``zone``.  The session time
    zone must be UTC (``newslake.session`` sets it).
    """
    return let(strip(text(value)), lambda raw: _parse(raw, zone))


def _parse(raw: Column, zone: str) -> Column:
    has_offset = raw.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & (F.length(raw) > 10)
    spelled = F.regexp_replace(F.replace(raw, F.lit(","), F.lit(".")), r"\s*([+-]\d{2}):?(\d{2})$", "$1:$2")
    spelled = F.when(raw.rlike(_ISO), F.when(F.length(raw) <= 10, raw).otherwise(spelled))
    iso = let(spelled.try_cast("timestamp"), lambda ts: F.when(has_offset, ts).otherwise(to_utc(ts, zone)))

    def mail(parts: Column) -> Column:
        offset = lookup(F.upper(parts["zone"]), _RFC_ZONES, parts["zone"])
        zoned = F.try_to_timestamp(F.concat_ws(" ", parts["stamp"], offset), F.lit("d MMM yyyy HH:mm:ss Z"))
        local = F.try_to_timestamp(parts["stamp"], F.lit("d MMM yyyy HH:mm:ss"))
        known = let(offset, lambda o: o.rlike(r"^[+-]\d{4}$") & (o != "-0000"))
        return F.when(parts["stamp"] == "", F.lit(None)).when(known, zoned).otherwise(to_utc(local, zone))

    stamp = F.regexp_replace(F.regexp_extract(raw, _RFC, 1), r"( \d{2}:\d{2})$", "$1:00")
    mailed = let(F.struct(stamp.alias("stamp"), F.regexp_extract(raw, _RFC, 2).alias("zone")), mail)
    dotted = F.coalesce(
        F.try_to_timestamp(F.when(raw.rlike(r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}$"), raw), F.lit("dd.MM.yyyy HH:mm")),
        F.try_to_timestamp(F.when(raw.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), raw), F.lit("dd.MM.yyyy")),
    )
    return F.coalesce(iso, mailed, to_utc(dotted, zone))


def date_text(ts: ColumnOrName, zone: str = "UTC") -> Column:
    return F.date_format(to_project(ts, zone), "yyyy-MM-dd")


def time_text(ts: ColumnOrName, zone: str = "UTC") -> Column:
    return F.date_format(to_project(ts, zone), "HH:mm")


def confidence_rank(c: ColumnOrName) -> Column:
    rank = F.lit(0)
    for name, value in lx.CONFIDENCE_RANK.items():
        rank = F.when(col(c) == name, F.lit(value)).otherwise(rank)
    return rank


def feed_date(published: ColumnOrName, updated: ColumnOrName, zone: str = "UTC") -> Column:
    """Feed dates with the confidence they deserve: published high, updated medium."""
    both = F.struct(parse_datetime(published, zone).alias("p"), parse_datetime(updated, zone).alias("u"))
    return let(both, lambda d: F.struct(
        F.coalesce(d["p"], d["u"]).alias("published_at"),
        F.when(d["p"].isNotNull(), "high").when(d["u"].isNotNull(), "medium").otherwise("none").alias("confidence"),
        F.when(d["p"].isNotNull(), "rss:published").when(d["u"].isNotNull(), "rss:updated").alias("label"),
    ))


def merge_page_date(feed: Column, page: Column) -> Column:
    """The page's date replaces the feed's when it is at least as trustworthy.

    Both arguments are structs with ``published_at, published_date,
    published_time, confidence, label``.
    """
    return let(F.struct(feed.alias("feed"), page.alias("page")), lambda d: _merge(d["feed"], d["page"]))


def _merge(feed: Column, page: Column) -> Column:
    held = F.coalesce(feed["confidence"], F.lit("none"))
    weak = feed["published_at"].isNull() | held.isin("none", "low")
    take = weak & page["confidence"].isNotNull() & (confidence_rank(page["confidence"]) >= confidence_rank(held))

    def pick(name: str) -> Column:
        return F.when(take, F.coalesce(page[name], feed[name])).otherwise(feed[name]).alias(name)

    return F.struct(
        pick("published_at"), pick("published_date"), pick("published_time"),
        F.when(take, page["confidence"]).otherwise(held).alias("confidence"), pick("label"),
    )


def surrogate_date(published_at: ColumnOrName, fetched_at: ColumnOrName, confidence: ColumnOrName, zone: str = "UTC") -> Column:
    """Fill a missing date from the fetch time and mark it as a surrogate."""
    at = F.coalesce(col(published_at), col(fetched_at))
    return F.struct(
        at.alias("published_at"),
        F.when(col(published_at).isNull(), "surrogate").otherwise(F.coalesce(col(confidence), F.lit("none"))).alias("confidence"),
        date_text(at, zone).alias("published_date"),
        time_text(at, zone).alias("published_time"),
    )
