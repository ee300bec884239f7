"""Fingerprint, exact-duplicate and near-duplicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.functions import fingerprint as fp, text as tx, urls
from newslake.operators import dedup, gates
from newslake.plans.common import arrived_within, feed_items, keep_first, stored_before
from newslake.plans.registry import REGISTRY as R
from newslake.plans.views import AS_OF
from newslake.sources.adapters import Tables, as_of


# ------------------------------------------------------------- fingerprints
@R.add("f01_checksum", views="items", sql="SELECT id, sha256(clean_text) AS checksum FROM items")
def f01(t: Tables) -> DataFrame:
    return t.items.select("id", fp.checksum("clean_text").alias("checksum"))


CANON_PAGES = r"""
    SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))
           || rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')
           || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical
    FROM (SELECT page_id, url, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
                 lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS q FROM pages)"""


@R.add("f02_canonical_url", views="feed_entries", sql=f"""
    SELECT 'page' AS kind, page_id AS id, canonical FROM ({CANON_PAGES})
    UNION ALL SELECT 'feed', entry_id, canonical FROM feed_entries""")
def f02(t: Tables) -> DataFrame:
    pages = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), urls.normalize_url("url").alias("canonical"))
    feed = t.feed_entries.select(F.lit("feed").alias("kind"), F.col("entry_id").alias("id"), urls.normalize_url("link").alias("canonical"))
    return pages.unionByName(feed)


@R.add("f03_url_hash", sql=f"SELECT page_id, sha256(canonical) AS url_hash FROM ({CANON_PAGES})")
def f03(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.url_hash("url").alias("url_hash"))


@R.add("f04_simhash", views="simhashes", sql="SELECT id, simhash FROM simhashes")
def f04(t: Tables) -> DataFrame:
    return t.wide_items.select("id", fp.simhash("clean_text", "title").alias("simhash"))


@R.add("f05_hamming", views="simhashes", sql="""
    SELECT a.id, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance
    FROM simhashes a JOIN simhashes b ON b.id = a.id + 1""")
def f05(t: Tables) -> DataFrame:
    prints = t.wide_items.select("id", fp.simhash("clean_text", "title").alias("simhash"))
    nxt = prints.select((F.col("id") - 1).alias("id"), F.col("simhash").alias("other"))
    return prints.join(nxt, "id").select("id", fp.hamming("simhash", "other").alias("distance"))


@R.add("f43_cache_key", views="items", sql="""
    SELECT id, md5('summarize|' || sha256(clean_text) || '|[["level", 3]]') AS by_checksum,
           md5('category|' || lower(trim(title, ' ' || chr(10))) || '|' || lower(trim(clean_text, ' ' || chr(10))) || '|[["current", "' || category || '"]]') AS by_text
    FROM items""")
def f43(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit('"'), "category", F.lit('"'))
    return t.items.select(
        "id", fp.cache_key("summarize", "title", "clean_text", fp.checksum("clean_text"), {"level": 3}).alias("by_checksum"),
        fp.cache_key("category", "title", "clean_text", None, {"current": quoted}).alias("by_text"))


@R.add("f44_text_fingerprint", views="items", sql="SELECT id, sha256(trim(clean_text, ' ' || chr(10))) AS fingerprint FROM items")
def f44(t: Tables) -> DataFrame:
    return t.items.select("id", fp.text_fingerprint("clean_text").alias("fingerprint"))


# ------------------------------------------------------------------- exact
STAGED = """
    WITH s1 AS (SELECT * FROM feed_items QUALIFY row_number() OVER (PARTITION BY flat ORDER BY arrival_idx) = 1),
    s2 AS (SELECT * FROM s1 QUALIFY url_hash = '' OR row_number() OVER (PARTITION BY url_hash ORDER BY arrival_idx) = 1),
    s3 AS (SELECT * FROM s2 QUALIFY checksum = '' OR row_number() OVER (PARTITION BY checksum ORDER BY arrival_idx) = 1),
    s4 AS (SELECT * FROM s3 QUALIFY url_normalized = '' OR row_number() OVER (PARTITION BY url_normalized ORDER BY arrival_idx) = 1)
    SELECT id, url FROM s4"""


@R.add("w01_staged_dedup", views="feed_items", sql=STAGED)
def w01(t: Tables) -> DataFrame:
    return dedup.staged_first_wins(feed_items(t)).select("id", "url")


@R.add("w01b_title_stage", views="titles", sql="""
    SELECT id FROM titles QUALIFY row_number() OVER (PARTITION BY flat ORDER BY arrival_idx) = 1""")
def w01b(t: Tables) -> DataFrame:
    return dedup.staged_first_wins(t.items, {"k_title": F.concat(F.lit("t"), F.md5(tx.normalized_title("title")))}).select("id")


@R.add("j01_unseen_keys", views="feed_items items", sql=f"""
    SELECT id FROM feed_items f WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.published_at <= {AS_OF} - INTERVAL 24 HOUR AND i.guid = f.guid)
      AND NOT EXISTS (SELECT 1 FROM items i WHERE i.published_at <= {AS_OF} - INTERVAL 24 HOUR AND sha256(i.url) = f.url_hash)""")
def j01(t: Tables) -> DataFrame:
    store = stored_before(t, 24).select("guid", urls.url_hash("url").alias("url_hash"))
    return dedup.unseen_keys(feed_items(t), store).select("id")


@R.add("j02_unseen_addresses", views="feed_items items", sql=f"""
    SELECT id FROM feed_items f WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.published_at <= {AS_OF} - INTERVAL 24 HOUR AND i.url = f.url_normalized)""")
def j02(t: Tables) -> DataFrame:
    store = stored_before(t, 24).select(urls.normalize_url("url").alias("url_normalized"))
    return dedup.unseen_addresses(feed_items(t), store).select("id")


@R.add("j03_unseen_checksums", views="items", sql=f"""
    SELECT id FROM items n WHERE published_at > {AS_OF} - INTERVAL 24 HOUR AND NOT EXISTS (
      SELECT 1 FROM items i WHERE i.published_at <= {AS_OF} - INTERVAL 24 HOUR AND i.published_at > {AS_OF} - INTERVAL 48 HOUR
        AND i.clean_text = n.clean_text)""")
def j03(t: Tables) -> DataFrame:
    new = arrived_within(t, 24).withColumn("checksum", fp.checksum("clean_text"))
    store = stored_before(t, 24).select("published_at", fp.checksum("clean_text").alias("checksum"))
    return dedup.unseen_checksums(new, store, as_of(), 48).select("id")


@R.add("p07_existing_urls", views="feed_entries items", sql="""
    SELECT entry_id FROM feed_entries f WHERE EXISTS (SELECT 1 FROM items i WHERE i.url = f.canonical)""")
def p07(t: Tables) -> DataFrame:
    known = t.items.select("url")
    return t.feed_entries.select("entry_id", urls.normalize_url("link").alias("url")).join(known, "url", "left_semi").select("entry_id")


@R.add("p13_first_seen", views="feed_items items", sql=f"""
    WITH s AS (SELECT guid, sha256(url) AS h FROM items WHERE published_at <= {AS_OF} - INTERVAL 24 HOUR)
    SELECT id, CASE WHEN id % 3 <> 0 THEN NOT (coalesce(guid IN (SELECT guid FROM s), FALSE) OR url_hash IN (SELECT h FROM s)) END AS is_first_seen
    FROM feed_items""")
def p13(t: Tables) -> DataFrame:
    store = stored_before(t, 24).select("guid", urls.url_hash("url").alias("url_hash"))
    rows = feed_items(t).withColumns({
        "published_confidence": F.when(F.col("id") % 3 == 0, "high").when(F.col("id") % 3 == 1, "none"),
        "fetched_at": as_of()})
    return gates.first_seen(rows, store).select("id", "is_first_seen")


# -------------------------------------------------------------------- near
@R.add("o02_recent_fingerprints", views="simhashes", sql=f"""
    SELECT simhash FROM simhashes WHERE simhash IS NOT NULL AND published_at > {AS_OF} - INTERVAL 48 HOUR
    ORDER BY published_at DESC, id DESC LIMIT 100""")
def o02(t: Tables) -> DataFrame:
    return dedup.recent_fingerprints(_prints(t.wide_items.filter(F.col("published_at") > as_of() - F.expr("interval 48 hours"))), as_of(), 48, 100)


def _prints(items: DataFrame) -> DataFrame:
    return items.select("id", "published_at", fp.simhash("clean_text", "title").alias("simhash"))


J04 = f"""
    WITH r AS (SELECT simhash FROM simhashes WHERE simhash IS NOT NULL AND published_at <= {AS_OF} - INTERVAL 12 HOUR
                 AND published_at > {AS_OF} - INTERVAL 48 HOUR)
    SELECT id FROM simhashes n WHERE published_at > {AS_OF} - INTERVAL 12 HOUR
      AND NOT EXISTS (SELECT 1 FROM r WHERE bit_count(xor(n.simhash, r.simhash)) <= 6)"""


@R.add("j04_near_duplicates", views="simhashes", sql=J04)
def j04(t: Tables) -> DataFrame:
    """New items without a near copy among the stored fingerprints of the last 48 hours."""
    late, horizon = as_of() - F.make_dt_interval(hours=F.lit(12)), as_of() - F.expr("interval 48 hours")
    new = _prints(t.wide_items.filter(F.col("published_at") > late))
    old = _prints(t.wide_items.filter((F.col("published_at") <= late) & (F.col("published_at") > horizon)))
    return dedup.not_near_stored(new, dedup.recent_fingerprints(old, as_of(), 48)).select("id")


@R.add("j04b_near_all", views="simhashes", sql=f"""
    SELECT id FROM simhashes n WHERE published_at > {AS_OF} - INTERVAL 12 HOUR AND EXISTS (
      SELECT 1 FROM simhashes r WHERE r.published_at <= {AS_OF} - INTERVAL 12 HOUR AND bit_count(xor(n.simhash, r.simhash)) <= 6)""")
def j04b(t: Tables) -> DataFrame:
    """New items with a near copy anywhere in the store (unbounded: keyed shuffle join)."""
    late = as_of() - F.make_dt_interval(hours=F.lit(12))
    return dedup.near_stored(_prints(t.wide_items.filter(F.col("published_at") > late)),
                             _prints(t.wide_items.filter(F.col("published_at") <= late))).select("id")


@R.add("j05_similar_titles", views="title_sets", sql=f"""
    SELECT DISTINCT n.id FROM title_sets n JOIN title_sets o ON n.published_at > {AS_OF} - INTERVAL 12 HOUR
       AND o.published_at <= {AS_OF} - INTERVAL 12 HOUR AND o.published_at > {AS_OF} - INTERVAL 24 HOUR
       AND len(n.words) >= 3 AND len(o.words) >= 3
    WHERE n.norm = o.norm OR (length(n.norm) > 40 AND (contains(o.norm, n.norm) OR contains(n.norm, o.norm)))
       OR len(list_intersect(n.words, o.words))::DOUBLE / len(list_distinct(list_concat(n.words, o.words))) >= 0.85""")
def j05(t: Tables) -> DataFrame:
    store = stored_before(t, 12).filter(F.col("published_at") > as_of() - F.expr("interval 1 day"))
    return dedup.similar_titles(arrived_within(t, 12), store, 0.85).select("id")


@R.add("u05_title_jaccard", views="title_sets", sql="""
    SELECT a.id, CAST(len(list_intersect(a.words, b.words)) AS INTEGER) AS common,
           round(CASE WHEN len(list_distinct(list_concat(a.words, b.words))) > 0
             THEN len(list_intersect(a.words, b.words))::DOUBLE / len(list_distinct(list_concat(a.words, b.words))) END, 6) AS similarity
    FROM title_sets a JOIN title_sets b ON b.id = a.id + 20""")
def u05(t: Tables) -> DataFrame:
    sets = t.items.select("id", tx.title_words("title").alias("w"))
    nxt = sets.select((F.col("id") - 20).alias("id"), F.col("w").alias("o"))
    union = F.size(F.array_union("w", "o"))
    return sets.join(nxt, "id").select(
        "id", F.size(F.array_intersect("w", "o")).alias("common"),
        F.round(F.when(union > 0, tx.jaccard(F.col("w"), F.col("o"))), 6).alias("similarity"))


@R.add("w08_tick_cap", views="items", sql="""
    SELECT tick_id, id FROM (SELECT strftime(fetched_at, '%Y-%m-%d') AS tick_id, id, arrival_idx FROM items)
    QUALIFY row_number() OVER (PARTITION BY tick_id ORDER BY arrival_idx) <= 40""")
def w08(t: Tables) -> DataFrame:
    rows = t.items.select(F.date_format("fetched_at", "yyyy-MM-dd").alias("tick_id"), "id", "arrival_idx")
    return dedup.cap_per_tick(rows, 40).select("tick_id", "id")


@R.add("w09_greedy_keep_first", views="items near_conflicts title_conflicts",
       sql=keep_first("(SELECT * FROM near_conflicts UNION SELECT * FROM title_conflicts)"))
def w09(t: Tables) -> DataFrame:
    items = t.wide_items.select("id", "arrival_idx", "guid", "title", "published_at", fp.simhash("clean_text", "title").alias("simhash"))
    return dedup.near_duplicate_resolution(items, as_of()).select("id")


