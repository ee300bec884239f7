"""Scans, the source catalogue and the source registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.functions import lexicon as lx
from newslake.functions.base import any_of, lookup, text
from newslake.functions.urls import authority
from newslake.operators import ordered
from newslake.schemas import schema


def scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Stored table with its fixed schema: no inference, missing columns read as null."""
    return spark.read.schema(schema(name)).parquet(path)


def cached_feed_items(cache: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Items of cached feeds that are younger than the limit."""
    fresh = cache.filter(F.col("cached_at") > as_of - F.make_dt_interval(hours=F.lit(hours)))
    entries = F.from_json("items", "array<struct<title:string,url:string>>")
    return fresh.select(F.col("url").alias("feed_url"), F.posexplode(entries).alias("pos", "e")).select(
        "feed_url", F.col("pos").cast("bigint").alias("pos"), "e.title", "e.url")


def flatten_catalogue(config: DataFrame, mirror_root: str | None = None, overrides: dict[str, str] | None = None,
                      html_only: list[str] | None = None) -> DataFrame:
    """Nested catalogue (map of group → struct<category, sources>) to one row per fetch address.

    Known feed addresses replace the site; channels and accounts go through the
    mirror root; others are feeds if the address looks like one, else pages.
    The first row per (fetch_url, name) stays.
    """
    rows = config.select("ord", F.explode("groups").alias("group", "g")).select(
        "ord", "group", "g.category", F.posexplode("g.sources").alias("pos", "src"))
    src = F.col("src")
    domain = F.lower(authority("src"))
    known = lookup(domain, overrides if overrides is not None else lx.FEED_OVERRIDES)
    pages = domain.isin(html_only if html_only is not None else lx.HTML_ONLY_DOMAINS)
    low = F.lower("src")
    feedlike = F.contains(low, F.lit("rss")) | low.rlike(r"\.(xml|rss)$")
    channel = F.contains(domain, F.lit("t.me"))
    account = F.contains(domain, F.lit("x.com")) | F.contains(domain, F.lit("twitter.com"))
    handle = F.trim(F.regexp_replace(src, r"https?://(?:t\.me|x\.com|twitter\.com)/|@", ""))
    handle = F.btrim(handle, F.lit("/"))
    root = F.lit((mirror_root or "").rstrip("/"))
    special = ~feedlike & known.isNull() & ~pages
    flat = rows.select(
        "ord", "group", "pos", "category",
        F.when(known.isNotNull(), known)
        .when(special & channel, F.concat(root, F.lit("/telegram/channel/"), handle))
        .when(special & account, F.concat(root, F.lit("/twitter/user/"), handle)).otherwise(src).alias("fetch_url"),
        F.when(special & channel, handle).when(special & account, F.concat(F.lit("@"), handle)).otherwise(domain).alias("source"),
        F.when(known.isNotNull() | (special & (channel | account)) | (~pages & feedlike), "rss").otherwise("html").alias("kind"),
        (special & (channel | account)).alias("_mirrored"),
    )
    if not mirror_root:
        flat = flat.filter(~F.col("_mirrored"))
    return ordered.first_row(flat.drop("_mirrored"), ["fetch_url", "source"], ["ord", "pos"])


def source_maps(catalogue: DataFrame) -> DataFrame:
    """Kind, group and label of each source; the first catalogue row per source decides."""
    url, name = F.col("fetch_url"), F.col("source")
    tele = F.contains(url, F.lit("/telegram/channel/"))
    rows = ordered.first_row(catalogue, ["source"], ["ord", "pos"])
    return rows.select(
        "source",
        F.when(tele, "api").when(F.contains(url, F.lit("/twitter/user/")), "x/twitter")
        .when(name.isin(lx.TRUSTED_WORLD_SOURCES), "yahoo").when(F.col("kind") == "rss", "rss").otherwise("html").alias("source_type"),
        F.when(tele, "telegram").otherwise("site").alias("source_group"),
        F.when(tele, F.concat(F.lit("@"), name)).otherwise(name).alias("label"),
    )


def registry_rows(addresses: DataFrame, url: str = "url") -> DataFrame:
    """Code and title of each address, one row per code."""
    bare = F.regexp_replace(F.col(url), "^https?://", "")
    channel = F.contains(F.col(url), F.lit("t.me"))
    handle = F.btrim(F.replace(F.regexp_replace(F.col(url), r"https?://t\.me/", ""), F.lit("@"), F.lit("")), F.lit("/"))
    code = F.when(channel, handle).otherwise(F.split_part(bare, F.lit("/"), F.lit(1)))
    title = F.when(channel, F.concat(F.lit("@"), code)).otherwise(code)
    return addresses.select(code.alias("code"), title.alias("title")).filter(F.col("code") != "").groupBy("code").agg(F.min("title").alias("title"))


def register(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """New registry rows with ids after the highest present one."""
    fresh = candidates.join(existing.select("code"), "code", "left_anti")
    top = F.coalesce(existing.agg(F.max("id")).scalar(), F.lit(0))
    return ordered.global_row_number(fresh, ["code"], "id", top).select(
        "id", "code", "title", F.lit(True).alias("enabled_global"))


def search_sources(sources: DataFrame, needles: list[str]) -> DataFrame:
    """Distinct (code, title) where either contains one of the needles, ignoring case."""
    rx = any_of(n.lower() for n in needles)
    return sources.filter(F.lower("code").rlike(rx) | F.lower("title").rlike(rx)).select("code", "title").distinct()


def newest(items: DataFrame, n: int = 100) -> DataFrame:
    return items.select("id", "url", "title", "source", "category", "published_at").orderBy(F.desc("published_at"), F.desc("id")).limit(n)


def after_id(items: DataFrame, last_id: int | None, n: int = 50) -> DataFrame:
    """Next page of items by id."""
    rows = items if last_id is None else items.filter(F.col("id") > last_id)
    return rows.orderBy("id").limit(n)


def in_period(items: DataFrame, start: Column, end: Column) -> DataFrame:
    return items.filter(F.col("published_at").between(start, end)).orderBy(F.desc("published_at"), F.desc("id"))


def union_batches(*batches: DataFrame) -> DataFrame:
    """All source batches as one, by column name; columns a batch lacks are null."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def collected_counts(catalogue: DataFrame, items: DataFrame) -> DataFrame:
    counts = items.groupBy("source").agg(F.count("*").alias("n"))
    return catalogue.select("source").distinct().join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def read_log_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of log files with a number that grows along each file."""
    place = F.monotonically_increasing_id()
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), place.alias("line_no"), text("value").alias("line"))
