"""Freshness, quality and routing predicates of single items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions import lexicon as lx
from newslake.functions import text as tx
from newslake.functions.base import blank_to_null, col, contains_any, first_filled, lookup, strip, text
from newslake.functions.dates import date_text, parse_datetime, time_text, to_project

FUTURE_SLACK = "interval 5 minutes"


def freshness_reason(as_of: Column, published_at: Column, published_date: Column, fallback_at: Column, domain: Column,
                     unparsable: Column | None = None, zone: str = "UTC", hours: int = lx.FRESHNESS_HOURS,
                     days_by_domain: dict[str, int] | None = None) -> Column:
    """Null for a fresh item, else why it is dropped.

    A missing time falls back to the date (midnight), then to the fetch time.
    ``unparsable`` marks rows whose date text could not be read.
    """
    days = days_by_domain if days_by_domain is not None else lx.FRESHNESS_DAYS_BY_DOMAIN
    bad_text = F.coalesce(unparsable, F.lit(False)) if unparsable is not None else F.lit(False)
    filled_date = blank_to_null(published_date)
    day = F.try_to_timestamp(F.substring(filled_date, 1, 10), F.lit("yyyy-MM-dd"))
    bad_date = published_at.isNull() & filled_date.isNotNull() & day.isNull()
    at = to_project(F.coalesce(published_at, day, fallback_at), zone)
    now = to_project(as_of, zone)
    limit = F.lit(hours)
    for name, d in days.items():
        limit = F.when(domain == name, F.lit(d * 24)).otherwise(limit)
    return (
        F.when(bad_date, "PARSE_DATE_FAILED")
        .when(published_at.isNull() & day.isNull() & bad_text, "PARSE_DATE_FAILED")
        .when(at.isNull(), "NO_PUBLISHED_DATE")
        .when(at > now + F.expr(FUTURE_SLACK), "PARSE_DATE_FAILED")
        .when(at < now - F.make_dt_interval(hours=limit), "OLD_PUBLISHED_AT")
    )


def with_freshness(items: DataFrame, as_of: Column, **kwargs) -> DataFrame:
    """Add ``reason`` to items of the canonical schema."""
    have = set(items.columns)
    opt = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    return items.withColumn("reason", freshness_reason(
        as_of, F.col("published_at"), opt("published_date", "string"),
        F.coalesce(opt("fetched_at", "timestamp"), opt("first_seen_at", "timestamp")), F.col("domain"), **kwargs,
    ))


def drop_event(items: DataFrame) -> DataFrame:
    """Event rows for rejected items."""
    reason = F.col("reason")
    return items.filter(reason.isNotNull()).select(
        "id", "source",
        F.when(reason == "OLD_PUBLISHED_AT", "drop_old")
        .when(reason.isin("NO_PUBLISHED_DATE", "PARSE_DATE_FAILED"), "drop_date").otherwise("error").alias("event_type"),
        F.when(reason != "OLD_PUBLISHED_AT", reason).alias("error_code"),
    )


def body_or_title(body: Column, title: Column, min_len: Column | int) -> Column:
    """Struct (text, used_title): a body that is too short gives way to the title."""
    use = (F.length(strip(text(body))) < min_len) & (text(title) != "")
    return F.struct(F.when(use, strip(title)).otherwise(text(body)).alias("text"), use.alias("used_title"))


def with_quality_gate(items: DataFrame, body: str, title: str, source: str, kind: str, relayed: Column | None = None,
                      long_sources: list[str] | None = None, phrases: list[str] | None = None) -> DataFrame:
    """Title fallback, score and rejection reason of collected items.

    ``kind`` holds rss or html; ``relayed`` marks items of channel mirrors;
    sources of ``long_sources`` must bring long, good texts.
    """
    is_long = contains_any(F.col(source), long_sources or ["lenta.ru", "ria.ru"])
    relay = F.coalesce(relayed, F.lit(False)) if relayed is not None else F.lit(False)
    relay = relay & (F.col(kind) == "rss")
    base_len = F.when(is_long, 400).when(F.col(kind) == "rss", 20).otherwise(40)
    min_len = F.when(relay, 40).otherwise(base_len)
    out = items.withColumn("_f", body_or_title(F.col(body), F.col(title), base_len)) \
        .withColumn("gate_text", F.col("_f.text")).withColumn("used_title", F.col("_f.used_title")).drop("_f") \
        .withColumn("quality_score", tx.quality_score("gate_text", phrases))
    min_score = (
        F.when(relay, F.lit(0.4)).when(F.col("used_title") & ~is_long, F.lit(0.2))
        .when(is_long, F.lit(0.65)).otherwise(F.lit(0.55))
    )
    size = F.length(strip("gate_text"))
    return out.withColumn(
        "gate_reason",
        F.when(size < min_len, "TOO_SHORT").when(tx.is_low_quality("quality_score", min_score), "LOW_QUALITY"),
    )


def category_matches(wanted: Column, category: Column) -> Column:
    """No filter set passes everything."""
    return wanted.isNull() | (wanted == "") | F.coalesce(category == wanted, F.lit(False))


def in_env(env: Column, wanted: str) -> Column:
    return env.isNull() | (env == wanted)


def tags_or_english(tags_ru: Column, tags_en: Column) -> Column:
    return F.coalesce(blank_to_null(tags_ru), tags_en, F.lit(""))


def content_of(summary: Column, clean: Column, lead: Column) -> Column:
    return F.coalesce(first_filled(summary, clean, lead), F.lit(""))


def tags_or_category(tags: Column, category: Column) -> Column:
    fallback = lookup(category, lx.CATEGORY_TAGS["ru"], F.lit("#Россия"))
    return F.coalesce(blank_to_null(tags), fallback)


def export_rows(items: DataFrame, zone: str = "UTC") -> DataFrame:
    """The seven columns of a period export."""
    have = set(items.columns)
    opt = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    values = [
        F.coalesce(blank_to_null(opt("published_date")), date_text("published_at", zone), F.lit("")),
        F.coalesce(blank_to_null(opt("published_time")), time_text("published_at", zone), F.lit("")),
        text("source"), text("url"), text("title"),
        strip(content_of(opt("ai_summary"), opt("clean_text"), opt("lead_text"))),
        tags_or_category(tags_or_english(opt("hashtags_ru"), opt("hashtags_en")), F.col("category")),
    ]
    return items.select(*[v.alias(n) for v, n in zip(values, lx.EXPORT_COLUMNS)])


def final_category(source: Column, detected: Column, default: Column, trusted: list[str] | None = None) -> Column:
    return F.when(source.isin(trusted or lx.TRUSTED_WORLD_SOURCES), "world").otherwise(
        F.coalesce(blank_to_null(detected), default))


def first_seen(items: DataFrame, store: DataFrame) -> DataFrame:
    """Flag undated items whose guid and address are new, and stamp them with the fetch time."""
    undated = items.filter(F.lower(F.coalesce("published_confidence", F.lit("none"))) == "none")
    seen = seen_keys(undated, store).select("id").distinct().withColumn("_seen", F.lit(True))
    none = F.lower(F.coalesce(col("published_confidence"), F.lit("none"))) == "none"
    out = items.join(seen, "id", "left").withColumn("is_first_seen", F.when(none, F.col("_seen").isNull()))
    return out.withColumn("first_seen_at", F.when(F.col("is_first_seen"), F.col("fetched_at"))).drop("_seen")


def seen_keys(items: DataFrame, store: DataFrame) -> DataFrame:
    """Items whose guid or address hash is stored: two equality joins, never one OR condition."""
    by_guid = items.filter(text("guid") != "").join(store.select("guid").filter(text("guid") != "").distinct(), "guid", "left_semi")
    by_hash = items.filter(text("url_hash") != "").join(
        store.select("url_hash").filter(text("url_hash") != "").distinct(), "url_hash", "left_semi")
    return by_guid.select(*items.columns).unionByName(by_hash.select(*items.columns))


def summary_eligibility(body: Column, level: Column, manual: Column, auto_min: int = 200, manual_min: int = 20) -> Column:
    """Null when a text may be summarised, else the reason against it."""
    n = F.length(strip(text(body)))
    return (
        F.when(~manual & (text(body) != "") & (n < auto_min), "too_short")
        .when(level == 0, "disabled")
        .when(n < F.when(manual, manual_min).otherwise(auto_min), "too_short")
    )


def estimate_tokens(body: Column) -> Column:
    n = F.length(text(body))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4)))


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * F.lit(lx.PRICE_IN_PER_1K) / 1000 + tokens_out * F.lit(lx.PRICE_OUT_PER_1K) / 1000


def read_date(value: Column, zone: str = "UTC") -> Column:
    """Struct (at, unreadable) of a date text."""
    at = parse_datetime(value, zone)
    return F.struct(at.alias("at"), (blank_to_null(value).isNotNull() & at.isNull()).alias("unreadable"))
