"""One ingestion tick: from collected items to the rows that are published and the rows that are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions import fingerprint as fp, tagging as tg, text as tx, urls
from newslake.operators import dedup, gates
from newslake.session import cut


def enrich(items: DataFrame, tax: tg.Taxonomy = tg.DEFAULT, classify: bool = True) -> DataFrame:
    """Language, hashes, canonical address, fingerprint and category of collected items; all narrow."""
    have = set(items.columns)
    out = items.withColumns({
        "domain": urls.item_domain("domain" if "domain" in have else None, "url"),
        "language": tx.detect_language("clean_text", "title"),
        "checksum": fp.checksum("clean_text"),
        "simhash": fp.simhash("clean_text", "title"),
        "url_normalized": urls.normalize_url("url"),
    }).withColumn("url_hash", F.when(F.col("url_normalized") != "", F.sha2("url_normalized", 256)).otherwise(F.lit("")))
    if classify:
        out = out.withColumn("category", tg.classify("title", "clean_text", "url", tax))
    return out


def split_fresh(items: DataFrame, as_of: Column, **kwargs) -> tuple[DataFrame, DataFrame]:
    """(fresh items, event rows of the rejected ones)."""
    judged = gates.with_freshness(items, as_of, **kwargs)
    return judged.filter(F.col("reason").isNull()).drop("reason"), gates.drop_event(judged)


KEY_COLUMNS = ["id", "arrival_idx", "title", "guid", "url_hash", "checksum", "url_normalized", "simhash", "published_at"]


def publishable_ids(items: DataFrame, store: DataFrame, as_of: Column, category: str | None = None, limit: int | None = None,
                    title_threshold: float = 0.85) -> DataFrame:
    """Ids of the fresh, enriched items that survive all duplicate rules; with ``limit`` the first of them by arrival.

    Cheap rules run first, and all of them see key columns only; the caller joins the texts back for the
    survivors.  ``store`` holds the items published before.  Categories are computed only for a wanted one, as they take
    more time than all other keys.
    """
    if category:
        items = items.filter(gates.category_matches(F.lit(category), F.col("category")))
    rows = cut(items.select(*KEY_COLUMNS))  # written once, because several rules read the computed keys
    rows = dedup.staged_first_wins(rows)
    rows = dedup.unseen_keys(rows, store)
    rows = dedup.unseen_addresses(rows, store)
    rows = dedup.unseen_checksums(rows, store, as_of)
    rows = cut(dedup.not_near_stored(rows, dedup.recent_fingerprints(store, as_of)))
    day = store.filter(F.col("published_at") > as_of - F.expr("interval 1 day"))
    rows = rows.join(dedup.similar_titles(rows, day, title_threshold).select("id"), "id", "left_anti")
    rows = dedup.near_duplicate_resolution(rows, as_of, title_threshold).select("id", "arrival_idx")
    if limit is not None:
        rows = rows.orderBy("arrival_idx").limit(limit)
    return rows.select("id")


def success_events(rows: DataFrame, as_of: Column) -> DataFrame:
    """One ``success`` event per published row, dated at the tick; what the health boards count."""
    return rows.select("id", "source", F.lit("success").alias("event_type"), F.lit(None).cast("string").alias("error_code"),
                       as_of.cast("timestamp").alias("created_at"))


def with_tags(items: DataFrame, tax: tg.Taxonomy = tg.DEFAULT) -> DataFrame:
    ru = tg.stored_tags("title", "clean_text", "language", tax)
    return items.withColumn("hashtags_ru", ru).withColumn("hashtags_en", tg.english_tags(F.col("hashtags_ru")))


def tick(items: DataFrame, store: DataFrame, as_of: Column, tax: tg.Taxonomy = tg.DEFAULT, category: str | None = None,
         limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(published rows with tags, drop events) of one batch of collected items.

    The keys of all fresh items are computed once; the full rows are enriched and tagged only for the survivors.
    """
    judged = gates.with_freshness(items.withColumn("domain", urls.item_domain(None, "url")), as_of)
    fresh = judged.filter(F.col("reason").isNull()).drop("reason")
    ids = publishable_ids(enrich(fresh, tax), store, as_of, category, limit)
    return with_tags(enrich(fresh.join(ids, "id", "left_semi"), tax), tax), gates.drop_event(judged)
