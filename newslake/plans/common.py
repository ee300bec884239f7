"""Derived tables that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.functions import fingerprint as fp
from newslake.functions import urls
from newslake.functions.base import text
from newslake.functions.tagging import Taxonomy
from newslake.sources.adapters import Tables, as_of

# Word lists made of words that occur in the test tables (which hold no Cyrillic);
# the same operators run with the fixed lists by default.
DEMO = Taxonomy(
    category_patterns={
        "moscow": [r"\bthe\b", r"\bla\b"],
        "moscow_region": [r"\bdes\b", r"\bund\b", r"\bof the\b"],
        "world": [r"\band\b", r"\bthat", r"\bdie\b", r"\bque\b"],
    },
    region_aliases={"#Москва": ["ththe"], "#ТверскаяОбласть": ["leau"], "#ТульскаяОбласть": ["ungen", "chte"]},
    city_aliases={"#Москва": ["erer"], "#Тверь": ["oui"], "#Тула": ["sch"]},
    city_regions={"#Тверь": "#ТверскаяОбласть", "#Тула": "#ТульскаяОбласть"},
    region_capitals={"#ТверскаяОбласть": "#Тверь", "#ТульскаяОбласть": "#Тула"},
    world_markers=["ciónes", "anhe"], russia_markers=["tionre", "bleed"],
    rubric_keywords={"#Политика": ["thandst"], "#Общество": ["wh an"], "#Экономика": ["ß"], "#Спорт": ["elle"], "#Авто": ["cos"]},
    rubric_words={"#Политика": ["thand"], "#Экономика": ["auf", "zu"], "#Спорт": ["elle", "sur"], "#Технологии_медиа": ["ing"],
                  "#Образование": ["los"]},
    russia_strong="of the|la|und|los",
)
DEMO_NOISE = ["the ", "tion", "und", "que", "leau", "ción", "ing of"]
DEMO_STOP = ["thandst", "ciónes", "leaux", "schen", "blest"]


def tick_start(hours: int = 12):
    return as_of() - F.make_dt_interval(hours=F.lit(hours))


def printed(items: DataFrame) -> DataFrame:
    """Items with domain, canonical address, hashes and fingerprint."""
    normal = urls.normalize_url("url")
    return (
        items.withColumn("domain", urls.item_domain(None, "url"))
        .withColumn("url_normalized", normal)
        .withColumn("url_hash", F.when(F.col("url_normalized") != "", F.sha2("url_normalized", 256)).otherwise(F.lit("")))
        .withColumn("checksum", fp.checksum("clean_text"))
        .withColumn("simhash", fp.simhash("clean_text", "title"))
    )


def feed_items(t: Tables) -> DataFrame:
    """Feed entries as a batch of items."""
    normal = urls.normalize_url("link")
    return t.feed_entries.select(
        F.col("entry_id").alias("id"), F.col("entry_id").alias("arrival_idx"), "title", F.col("link").alias("url"), "guid",
        normal.alias("url_normalized"), fp.checksum("summary").alias("checksum"), text("source").alias("source"),
    ).withColumn("url_hash", F.when(F.col("url_normalized") != "", F.sha2("url_normalized", 256)).otherwise(F.lit("")))


def stored_before(t: Tables, hours: int) -> DataFrame:
    """Items published before the tick of the last ``hours``."""
    return t.items.filter(F.col("published_at") <= tick_start(hours))


def arrived_within(t: Tables, hours: int) -> DataFrame:
    return t.items.filter(F.col("published_at") > tick_start(hours))


def keep_first(conflicts: str) -> str:
    """SQL of sequential keep-first over the items: an item falls if an earlier kept item conflicts with it."""
    return f"""
    WITH RECURSIVE n AS MATERIALIZED (SELECT i.id, row_number() OVER (ORDER BY i.arrival_idx) AS rn, coalesce(c.es, CAST([] AS BIGINT[])) AS es
        FROM items i LEFT JOIN (SELECT l, list(e) AS es FROM {conflicts} GROUP BY l) c ON c.l = i.id),
    k AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept
      UNION ALL SELECT n.rn, CASE WHEN list_has_any(k.kept, n.es) THEN k.kept ELSE list_append(k.kept, n.id) END
      FROM k JOIN n ON n.rn = k.rn + 1)
    SELECT unnest(kept) AS id FROM k WHERE rn = (SELECT max(rn) FROM k)"""
