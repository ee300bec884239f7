"""Landed feeds and pages → item rows, links, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.functions import dates, lexicon as lx, pages as pg, text as tx
from newslake.functions.base import any_of, first_filled, strings, text, word_count
from newslake.functions.urls import absolute_url, normalize_url
from newslake.operators import ordered

FEED_ITEM = "title string, link string, guid string, description string, pubDate string, updated string"


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed feed documents (one row per <item>), numbered along each file."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(path)
    return rows.select(
        F.col("_metadata.file_path").alias("feed_url"), F.monotonically_increasing_id().alias("pos"), "title", "link",
        "guid", F.col("description").alias("summary"), F.col("pubDate").alias("published"), "updated")


def entries_to_items(entries: DataFrame, per_feed: int = 10, zone: str = "UTC") -> DataFrame:
    """First entries of each feed as items: default title, guid fallback, dates with confidence; no link, no item."""
    top = ordered.first_n(entries, ["feed_url"], ["pos"], per_feed)
    return (
        top.filter(text("link") != "")
        .withColumn("_d", dates.feed_date("published", "updated", zone))
        .select(
            "feed_url", "pos", F.coalesce("title", F.lit("No title")).alias("title"), F.col("link").alias("url"),
            first_filled("guid", "link").alias("guid"), "summary",
            F.col("_d.published_at").alias("published_at"), F.col("_d.confidence").alias("published_confidence"),
            F.col("_d.label").alias("published_source"),
        )
    )


def with_pages(items: DataFrame, pages: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Attach the landed page of each item by canonical address.

    Items that need no page (``wanted`` false) skip the join, so their rows are not shuffled with page bodies.  The first
    page of an address is found on ids alone, and bodies are read for the pages that some item needs.
    """
    first = pages.groupBy(normalize_url("url").alias("_k")).agg(F.min("page_id").alias("_page"))
    need = items if wanted is None else items.filter(wanted)
    ids = need.withColumn("_k", normalize_url("url")).join(first, "_k", "left").drop("_k")
    bodies = pages.select(F.col("page_id").alias("_page"), "html")
    joined = ids.join(bodies, "_page", "left").drop("_page")
    if wanted is None:
        return joined
    return joined.unionByName(items.filter(~wanted | wanted.isNull()).withColumn("html", F.lit(None).cast("string")))


def link_candidates(pages: DataFrame, source: Column, noise: list[str] | None = None) -> DataFrame:
    """Links of a listing page that look like articles, in page order, up to the site's limit."""
    short = source.rlike(any_of(lx.SHORT_LINK_TEXT_SITES))
    min_len = F.when(short, 8).otherwise(10)
    most = F.when(short, 25).otherwise(15)
    return _links(pages, min_len, most, noise=noise)


def _links(pages: DataFrame, min_len: Column, most: Column, paths: Column | None = None, noise: list[str] | None = None) -> DataFrame:
    """Filter and cap inside the page's own row: no explode before the cap and no shuffle."""
    good = F.filter(
        F.transform(pg.anchors("html"), lambda a: F.struct(absolute_url(a["href"], "url").alias("link"), a["label"].alias("title"))),
        lambda a: (F.length(a["title"]) >= min_len) & tx.is_valid_title(a["title"], noise) & F.startswith(a["link"], F.lit("http")),
    )
    if paths is not None:
        good = F.filter(good, lambda a: F.exists(paths, lambda p: F.contains(a["link"], p)) | (F.size(paths) == 0))
    return pages.select("page_id", F.posexplode(F.slice(good, F.lit(1), most)).alias("pos", "a")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "a.title", F.col("a.link").alias("url"))


def site_links(pages: DataFrame, source: str, rules: list[tuple] | None = None, noise: list[str] | None = None) -> DataFrame:
    """Links by the site's own rule: path allow-list, limit and text length.

    ``rules`` (marker, listing, paths, max_items, min_len) is a handful of configured sites, tested inside the page's own row.
    """
    table = F.array(*[F.struct(
        F.lit(marker).alias("marker"), F.lit(listing).alias("listing"), strings(paths).alias("paths"), F.lit(most).alias("max_items"),
        F.lit(least).alias("min_len")) for marker, listing, paths, most, least in (rules or lx.SITE_LINK_RULES)])
    fits = F.filter(table, lambda r: F.contains(F.lower(F.col(source)), r["marker"]) & F.contains(F.lower("url"), r["listing"]))
    matched = pages.withColumn("_rule", F.explode(fits)).select("*", "_rule.*").drop("_rule")
    return _links(matched, F.col("min_len"), F.col("max_items"), F.col("paths"), noise)


def article_cards(pages: DataFrame, per_page: int = 10, noise: list[str] | None = None) -> DataFrame:
    """Article blocks of a listing page: the first ``per_page`` blocks, of which those with a good title and a link stay."""
    cards = F.slice(pg.cards("html"), 1, per_page)
    made = F.transform(cards, lambda c: F.struct(
        F.substring(c["title"], 1, 200).alias("title"),
        F.when(c["href"] != "", F.when(F.startswith(c["href"], F.lit("http")), c["href"]).otherwise(absolute_url(c["href"], "url")))
        .alias("link"),
        F.substring(c["summary"], 1, 800).alias("body"),
        (tx.is_valid_title(c["title"], noise) & (F.length(c["title"]) >= 15) & (word_count(c["title"]) >= 3)).alias("ok")))
    good = F.filter(made, lambda c: c["ok"] & c["link"].isNotNull())
    return pages.select("page_id", F.posexplode(good).alias("pos", "c")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "c.title", F.col("c.link").alias("url"), F.col("c.body").alias("body"))
