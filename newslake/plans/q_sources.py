"""Scan, feed, catalogue, gate, sort and sink queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.functions import lexicon as lx, dates, urls
from newslake.functions.base import text
from newslake.operators import audit, gates, health, routing, usage
from newslake.plans.common import feed_items, stored_before
from newslake.plans.registry import REGISTRY as R
from newslake.plans.views import AS_OF
from newslake.schemas import conform
from newslake.sources import catalog, feeds, sinks
from newslake.sources.adapters import Tables, as_of

DUCK_TS = "%Y-%m-%d %H:%M:%S"
TS = "yyyy-MM-dd HH:mm:ss"


# ------------------------------------------------------------------- scans
@R.add("s01_item_scan", views="items", sql="SELECT id, url, title, source, category FROM items")
def s01(t: Tables) -> DataFrame:
    return conform(t.items, "items").select("id", "url", "title", "source", "category")


@R.add("s02_feed_items", views="feed_entries", sql=f"""
    SELECT feed_url, pos, coalesce(title, 'No title') AS title, link AS url, coalesce(nullif(guid, ''), link) AS guid,
           strftime(CASE entry_id % 4 WHEN 0 THEN stamp - INTERVAL 3 HOUR WHEN 1 THEN stamp ELSE CASE WHEN entry_id % 3 = 0 THEN stamp END END, '{DUCK_TS}') AS published_at,
           CASE WHEN entry_id % 4 < 2 THEN 'high' WHEN entry_id % 3 = 0 THEN 'medium' ELSE 'none' END AS published_confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY pos) AS rn FROM feed_entries) WHERE rn <= 10 AND link <> ''""")
def s02(t: Tables) -> DataFrame:
    rows = feeds.entries_to_items(t.feed_entries, 10)
    return rows.select("feed_url", "pos", "title", "url", "guid", F.date_format("published_at", TS).alias("published_at"), "published_confidence")


@R.add("w02_first_per_feed", views="feed_entries", sql="""
    SELECT feed_url, pos, entry_id FROM feed_entries QUALIFY row_number() OVER (PARTITION BY feed_url ORDER BY pos) <= 10""")
def w02(t: Tables) -> DataFrame:
    from newslake.operators.ordered import first_n
    return first_n(t.feed_entries, ["feed_url"], ["pos"], 10).select("feed_url", "pos", "entry_id")


@R.add("s04_items_with_pages", sql="""
    WITH u AS (SELECT page_id, html, regexp_replace(url, '#.*$', '') AS u, regexp_replace(url, '[?#].*$', '') AS bare FROM pages),
    p AS (SELECT rtrim(split_part(u, '?', 1), '/') || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
                   string_split(split_part(u, '?', 2), '&'), lambda x: NOT starts_with(x, 'utm_'))), '&'), ''), '') AS k,
                 arg_min(length(html), page_id) AS chars FROM u GROUP BY 1)
    SELECT page_id + 1 AS id, bare || '?utm_source=rss' AS url, CASE WHEN (page_id + 1) % 5 <> 0 THEN chars END AS page_chars
    FROM u LEFT JOIN p ON p.k = rtrim(bare, '/')""")
def s04(t: Tables) -> DataFrame:
    """Items that point at landed pages, with a tracking suffix that the canonical address removes."""
    items = t.pages.select((F.col("page_id") + 1).alias("id"), F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?utm_source=rss")).alias("url"))
    return feeds.with_pages(items, t.pages, F.col("id") % 5 != 0).select("id", "url", F.length("html").alias("page_chars"))


LINKS = """
    SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, a[2] AS title, {root} || a[1] AS url FROM (
      SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS pos FROM (
        SELECT page_id, url, list_filter(list_transform(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'),
                 lambda x: [{path} || regexp_extract(x, '"([^"]*)"', 1), trim(regexp_extract(x, '>([^<]*)<', 1))]),
               lambda x: starts_with(x[1], '/') AND length(x[2]) >= 10 AND NOT regexp_matches(lower(x[2]), '{noise}'))[:{most}] AS l FROM pages))"""


@R.add("s05_link_candidates", sql=LINKS.format(root="regexp_extract(url, '^[a-z]+://[^/?#]+')", path="''", noise="the,|heint", most=15))
def s05(t: Tables) -> DataFrame:
    return feeds.link_candidates(t.wide_pages, F.lower("url"), noise=["the,", "heint"])


@R.add("s06_site_links", sql=LINKS.format(root="'https://ren.tv'", path="'/news'", noise="heint", most=20))
def s06(t: Tables) -> DataFrame:
    """Site rules on pages whose host and links are written like the configured sites'."""
    pages = t.wide_pages.select(
        "page_id", F.concat(F.lit("https://ren.tv/news?from="), F.col("page_id").cast("string")).alias("url"),
        F.replace("html", F.lit('<a href="/'), F.lit('<a href="/news/')).alias("html"), F.lit("ren.tv").alias("source"))
    return feeds.site_links(pages, "source", noise=["heint"])


@R.add("s07_article_cards")
def s07(t: Tables) -> DataFrame:
    return feeds.article_cards(t.wide_pages.withColumn("html", F.replace("html", F.lit("</h1>"), F.lit('</h1><a href="/story">more</a>'))), 10, noise=["heint"])


@R.add("s08_cached_feed_items", views="items", sql=f"""
    SELECT feed_url, 0::BIGINT AS pos, title, 'u' || doc_id || 'a' AS url FROM (SELECT 'https://' || source || '.example.com/feed/' || doc_id AS feed_url, doc_id,
        split_part(text, chr(10), 1) AS title FROM documents WHERE {AS_OF} - to_hours(CAST(doc_id % 48 AS INTEGER)) > {AS_OF} - INTERVAL 24 HOUR)
    UNION ALL SELECT 'https://' || source || '.example.com/feed/' || doc_id, 1, 'second', 'u' || doc_id || 'b' FROM documents
    WHERE {AS_OF} - to_hours(CAST(doc_id % 48 AS INTEGER)) > {AS_OF} - INTERVAL 24 HOUR""")
def s08(t: Tables) -> DataFrame:
    return catalog.cached_feed_items(t.feed_cache, as_of(), 24)


# --------------------------------------------------------------- catalogue
def _catalogue(t: Tables) -> DataFrame:
    """A nested catalogue: one configuration row per page host group, written from the landed addresses."""
    host = urls.authority("url")
    k = F.col("page_id") % 7
    src = F.when(k == 0, F.concat(F.lit("https://t.me/"), F.regexp_extract(host, r"^([a-z-]+)", 1))) \
        .when(k == 1, F.concat(F.lit("https://x.com/"), F.regexp_extract(host, r"^([a-z-]+)", 1))) \
        .when(k == 2, F.concat(F.lit("https://"), host, F.lit("/rss/all.xml"))) \
        .when(k == 3, F.lit("https://ria.ru/world/")).when(k == 4, F.lit("https://ren.tv/news")).otherwise(F.concat(F.lit("https://"), host, F.lit("/")))
    group = F.struct(F.element_at(F.array(F.lit("world"), F.lit("russia")), (F.col("page_id") % 2 + 1).cast("int")).alias("category"), F.array(src, src).alias("sources"))
    return t.pages.select(F.col("page_id").alias("ord"), F.create_map(F.lit("g"), group).alias("groups"))


FLAT = r"""
    WITH p AS (SELECT page_id, page_id % 7 AS k, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CASE page_id % 2 WHEN 0 THEN 'world' ELSE 'russia' END AS category FROM pages),
    f AS (SELECT page_id, category, CASE k WHEN 0 THEN 'https://mirror.example.net/telegram/channel/' || regexp_extract(host, '^([a-z-]+)', 1)
                 WHEN 1 THEN 'https://mirror.example.net/twitter/user/' || regexp_extract(host, '^([a-z-]+)', 1) WHEN 2 THEN 'https://' || host || '/rss/all.xml'
                 WHEN 3 THEN 'https://ria.ru/export/rss2/archive/index.xml' WHEN 4 THEN 'https://ren.tv/news' ELSE 'https://' || host || '/' END AS fetch_url,
                 CASE k WHEN 0 THEN regexp_extract(host, '^([a-z-]+)', 1) WHEN 1 THEN '@' || regexp_extract(host, '^([a-z-]+)', 1) WHEN 3 THEN 'ria.ru' WHEN 4 THEN 'ren.tv' ELSE host END AS source,
                 CASE WHEN k < 4 THEN 'rss' ELSE 'html' END AS kind FROM p),
    flat AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY fetch_url, source ORDER BY page_id) = 1)
"""


def _flat(t: Tables) -> DataFrame:
    return catalog.flatten_catalogue(_catalogue(t), "https://mirror.example.net")


@R.add("s09_flat_catalogue", sql=FLAT + "SELECT fetch_url, source, category, kind FROM flat")
def s09(t: Tables) -> DataFrame:
    return _flat(t).select("fetch_url", "source", "category", "kind")


@R.add("u07_catalogue_distinct", sql=FLAT + "SELECT fetch_url, source FROM flat")
def u07(t: Tables) -> DataFrame:
    return _flat(t).dropDuplicates(["fetch_url", "source"]).select("fetch_url", "source")


@R.add("p18_source_maps", sql=FLAT + """
    SELECT source, CASE WHEN contains(fetch_url, '/telegram/channel/') THEN 'api' WHEN contains(fetch_url, '/twitter/user/') THEN 'x/twitter' ELSE kind END AS source_type,
           CASE WHEN contains(fetch_url, '/telegram/channel/') THEN 'telegram' ELSE 'site' END AS source_group,
           CASE WHEN contains(fetch_url, '/telegram/channel/') THEN '@' || source ELSE source END AS label
    FROM flat QUALIFY row_number() OVER (PARTITION BY source ORDER BY page_id) = 1""")
def p18(t: Tables) -> DataFrame:
    return catalog.source_maps(_flat(t))


@R.add("s10_source_registry", sql="""
    WITH c AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS code FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/?#]*/')),
    n AS (SELECT code FROM c WHERE code NOT IN (SELECT DISTINCT source FROM documents))
    SELECT (SELECT max(CAST(substr(source, 4) AS BIGINT)) + 1 FROM documents) + row_number() OVER (ORDER BY code) AS id, code, code AS title FROM n""")
def s10(t: Tables) -> DataFrame:
    return catalog.register(t.sources, catalog.registry_rows(t.pages)).select("id", "code", "title")


@R.add("p22_source_search", views="sources", sql="""
    SELECT DISTINCT code, title FROM sources WHERE lower(code) LIKE '%c1%' OR lower(title) LIKE '%c1%' OR lower(code) LIKE '%rc5%' OR lower(title) LIKE '%rc5%' ORDER BY code""")
def p22(t: Tables) -> DataFrame:
    return catalog.search_sources(t.sources, ["c1", "RC5"]).orderBy("code")


@R.add("u06_distinct_sources", views="sources", sql="SELECT DISTINCT code, title FROM sources")
def u06(t: Tables) -> DataFrame:
    return t.sources.select("code", "title").distinct()


@R.add("o04_sorted_lists", views="sources invites used_invites", sql="""
    SELECT 'source' AS kind, code AS name FROM sources UNION ALL SELECT 'invite', code FROM invites WHERE used_by IS NULL
    UNION ALL SELECT DISTINCT 'user', used_by FROM used_invites""")
def o04(t: Tables) -> DataFrame:
    used, approved = routing.redeem_invites(t.invite_requests, t.invites)
    del used
    lists = t.sources.select(F.lit("source").alias("kind"), F.col("code").alias("name"), F.col("title").alias("_s"), F.lit(None).cast("timestamp").alias("_t")) \
        .unionByName(t.invites.filter(text("used_by") == "").select(F.lit("invite").alias("kind"), F.col("code").alias("name"), F.lit("").alias("_s"), F.col("created_at").alias("_t"))) \
        .unionByName(approved.select(F.lit("user").alias("kind"), F.col("user_id").alias("name"), F.lit("").alias("_s"), F.lit(None).cast("timestamp").alias("_t")))
    return lists.orderBy("kind", "_s", F.desc("_t"), "name").select("kind", "name")


@R.add("u01_union_batches", views="items feed_items", sql="""
    SELECT id, url, title, guid FROM items UNION ALL SELECT id, url, title, guid FROM feed_items""")
def u01(t: Tables) -> DataFrame:
    return catalog.union_batches(t.items, feed_items(t)).select("id", "url", "title", "guid")


# ------------------------------------------------------------------- gates
P01_FEED = f"""
    SELECT entry_id, CASE WHEN at IS NULL AND entry_id % 4 = 3 THEN 'PARSE_DATE_FAILED' WHEN coalesce(at, fetched) IS NULL THEN 'NO_PUBLISHED_DATE'
        WHEN coalesce(at, fetched) > {AS_OF} + INTERVAL 5 MINUTE THEN 'PARSE_DATE_FAILED'
        WHEN coalesce(at, fetched) < {AS_OF} - to_hours(CASE domain WHEN 'src1.example.com' THEN 168 WHEN 'src2.example.com' THEN 48 ELSE 36 END) THEN 'OLD_PUBLISHED_AT' END AS reason
    FROM (SELECT entry_id, source || '.example.com' AS domain,
            CASE entry_id % 4 WHEN 0 THEN stamp + INTERVAL 3 HOUR WHEN 1 THEN stamp ELSE CASE WHEN entry_id % 3 = 0 THEN stamp END END AS "at",
            CASE WHEN entry_id % 2 = 0 THEN stamp END AS fetched FROM feed_entries)""".replace(" at ", ' "at" ').replace("(at,", '("at",')


@R.add("p01_freshness_gate", views="feed_entries", sql=P01_FEED)
def p01(t: Tables) -> DataFrame:
    at = dates.feed_date(F.regexp_replace("published", r"\+0300$", "-0300"), F.col("updated"))["published_at"]
    rows = t.feed_entries.select(
        "entry_id", at.alias("at"), F.concat("source", F.lit(".example.com")).alias("domain"),
        (F.coalesce(F.col("published"), F.lit("")) != "").alias("has_text"),
        F.when(F.col("entry_id") % 2 == 0, F.lit("2024-01-30 23:59:00").cast("timestamp") - F.make_dt_interval(hours=(F.col("entry_id") % 72).cast("int"))).alias("fetched"))
    reason = gates.freshness_reason(as_of(), F.col("at"), F.lit(None).cast("string"), F.col("fetched"), F.col("domain"),
                                    unparsable=F.col("has_text") & F.col("at").isNull(), days_by_domain={"src1.example.com": 7, "src2.example.com": 2})
    return rows.select("entry_id", reason.alias("reason"))


@R.add("p05_period", views="items", sql=f"""
    SELECT id, title FROM items WHERE published_at BETWEEN {AS_OF} - INTERVAL 30 HOUR AND TIMESTAMP '2024-01-30 12:59:00' ORDER BY published_at DESC, id DESC""")
def p05(t: Tables) -> DataFrame:
    end = F.lit("2024-01-30 12:59:00").cast("timestamp")
    return catalog.in_period(t.items, as_of() - F.expr("interval 30 hours"), end).select("id", "title")


@R.add("p06_lookup", views="items", sql="""
    SELECT id, url, title FROM items WHERE id = 42 OR url = 'https://src7.example.com/item/107'""")
def p06(t: Tables) -> DataFrame:
    return t.items.filter((F.col("id") == 42) | (F.col("url") == "https://src7.example.com/item/107")).select("id", "url", "title")


def _tagged(t: Tables) -> DataFrame:
    k = F.col("id")
    return t.items.withColumns({
        "hashtags_ru": F.when(k % 3 == 0, "#Мир #Спорт").when(k % 3 == 1, " "), "hashtags_en": F.when(k % 2 == 0, "#World #Sports"),
        "ai_summary": F.when(k % 5 == 0, F.concat(F.lit("summary "), "title")).when(k % 5 == 1, ""),
        "lead_text": F.col("title"), "clean_text": F.when(k % 7 != 0, F.col("clean_text"))})


TAGS = "CASE WHEN id % 3 = 0 THEN '#Мир #Спорт' WHEN id % 2 = 0 THEN '#World #Sports' ELSE '' END"
CONTENT = "CASE WHEN id % 5 = 0 THEN 'summary ' || title WHEN id % 7 <> 0 THEN clean_text ELSE title END"
CATEGORY_TAG = "CASE category WHEN 'world' THEN '#Мир' WHEN 'russia' THEN '#Россия' WHEN 'moscow' THEN '#Москва' WHEN 'moscow_region' THEN '#Подмосковье' END"


@R.add("p08_tags_column", views="items", sql=f"SELECT id, {TAGS} AS tags FROM items")
def p08(t: Tables) -> DataFrame:
    return _tagged(t).select("id", gates.tags_or_english(F.col("hashtags_ru"), F.col("hashtags_en")).alias("tags"))


@R.add("p09_content_fallback", views="items", sql=f"SELECT id, {CONTENT} AS content FROM items")
def p09(t: Tables) -> DataFrame:
    return _tagged(t).select("id", gates.content_of(F.col("ai_summary"), F.col("clean_text"), F.col("lead_text")).alias("content"))


@R.add("p10_tag_fallback", views="items", sql=f"SELECT id, CASE WHEN {TAGS} <> '' THEN {TAGS} ELSE {CATEGORY_TAG} END AS tags FROM items")
def p10(t: Tables) -> DataFrame:
    tags = gates.tags_or_english(F.col("hashtags_ru"), F.col("hashtags_en"))
    return _tagged(t).select("id", gates.tags_or_category(tags, F.col("category")).alias("tags"))


def _date_struct(at, conf, label):
    return F.struct(at.alias("published_at"), dates.date_text(at).alias("published_date"), dates.time_text(at).alias("published_time"),
                    conf.alias("confidence"), label.alias("label"))


@R.add("p11_date_merge", views="items", sql=f"""
    SELECT id, strftime(CASE WHEN take THEN coalesce(page_at, feed_at) ELSE feed_at END, '{DUCK_TS}') AS published_at,
           CASE WHEN take THEN pc ELSE fc END AS confidence, CASE WHEN take THEN 'page' ELSE 'feed' END AS label
    FROM (SELECT *, (feed_at IS NULL OR fc IN ('none', 'low')) AND
                 CASE pc WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END >= CASE fc WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS take
          FROM (SELECT id, CASE WHEN id % 3 <> 0 THEN published_at END AS feed_at, ['high', 'medium', 'low', 'none'][id % 4 + 1] AS fc,
                       CASE WHEN id % 2 = 0 THEN published_at + INTERVAL 1 HOUR END AS page_at, ['high', 'medium', 'low', 'none', 'none'][id % 5 + 1] AS pc FROM items))""")
def p11(t: Tables) -> DataFrame:
    k = F.col("id")
    pick = lambda n, *v: F.get(F.array(*[F.lit(x) for x in v]), (k % n).cast("int"))
    feed = _date_struct(F.when(k % 3 != 0, F.col("published_at")), pick(4, "high", "medium", "low", "none"), F.lit("feed"))
    page = _date_struct(F.when(k % 2 == 0, F.col("published_at") + F.expr("interval 1 hour")), pick(5, "high", "medium", "low", "none", "none"), F.lit("page"))
    d = t.items.select("id", dates.merge_page_date(feed, page).alias("d"))
    return d.select("id", F.date_format("d.published_at", TS).alias("published_at"), "d.confidence", "d.label")


@R.add("p12_surrogate_date", views="items", sql="""
    SELECT id, strftime(a, '%Y-%m-%d') AS published_date, strftime(a, '%H:%M') AS published_time, CASE WHEN id % 4 = 0 THEN 'surrogate' ELSE 'high' END AS confidence
    FROM (SELECT id, CASE WHEN id % 4 = 0 THEN fetched_at ELSE published_at END AS a FROM items)""")
def p12(t: Tables) -> DataFrame:
    rows = t.items.select("id", F.when(F.col("id") % 4 != 0, F.col("published_at")).alias("published_at"), "fetched_at", F.lit("high").alias("c"))
    d = rows.select("id", dates.surrogate_date("published_at", "fetched_at", "c").alias("d"))
    return d.select("id", "d.published_date", "d.published_time", "d.confidence")


@R.add("p15_no_article_fetch", views="items", sql="""
    SELECT id, contains(source || ' ' || url, 'src1.') OR contains(source || ' ' || url, 'src3') AS skip FROM items""")
def p15(t: Tables) -> DataFrame:
    return t.items.select("id", urls.skips_article_fetch("source", "url", ["src1.", "src3"]).alias("skip"))


@R.add("p17_drop_events", views="feed_entries", sql=f"""
    SELECT entry_id AS id, CASE WHEN reason = 'OLD_PUBLISHED_AT' THEN 'drop_old' ELSE 'drop_date' END AS event_type,
           CASE WHEN reason <> 'OLD_PUBLISHED_AT' THEN reason END AS error_code FROM ({P01_FEED}) WHERE reason IS NOT NULL""")
def p17(t: Tables) -> DataFrame:
    rows = p01(t).select(F.col("entry_id").alias("id"), F.lit("feed").alias("source"), "reason")
    return gates.drop_event(rows).select("id", "event_type", "error_code")


@R.add("p24_final_category", views="items", sql="""
    SELECT id, CASE WHEN source IN ('src0', 'src1') THEN 'world' WHEN id % 3 = 0 THEN 'moscow' ELSE category END AS category FROM items""")
def p24(t: Tables) -> DataFrame:
    detected = F.when(F.col("id") % 3 == 0, "moscow").when(F.col("id") % 3 == 1, "")
    return t.items.select("id", gates.final_category(F.col("source"), detected, F.col("category"), ["src0", "src1"]).alias("category"))


@R.add("p25_auto_summary", views="items settings", sql="""
    SELECT id FROM items WHERE source IN ('src3', 'src5') AND (SELECT max(CAST(value AS INTEGER)) + 1 FROM settings WHERE scope = 'global' AND key = 'ai_summary_level') = 5""")
def p25(t: Tables) -> DataFrame:
    level = usage.effective_levels(t.settings.filter("scope = 'global'").select(F.lit("global").alias("user_id")), t.settings, "summary").agg(F.max("level") + 1).scalar()
    return t.items.filter(F.col("source").isin("src3", "src5") & (level == 5)).select("id")


@R.add("f09_domain", views="items", sql="""
    SELECT id, CASE WHEN id % 3 = 0 THEN 'stored.example' WHEN id % 3 = 1 THEN source || '.example.com' ELSE 'unknown' END AS domain FROM items""")
def f09(t: Tables) -> DataFrame:
    rows = t.items.select("id", F.when(F.col("id") % 3 == 0, "Stored.EXAMPLE").alias("domain"), F.when(F.col("id") % 3 != 2, F.upper("url")).alias("url"))
    return rows.select("id", urls.item_domain("domain", "url").alias("domain"))


# ------------------------------------------------------------------- sorts
@R.add("o01_newest", views="items", sql="SELECT id, url, title FROM items ORDER BY published_at DESC, id DESC LIMIT 100")
def o01(t: Tables) -> DataFrame:
    return catalog.newest(t.items, 100).select("id", "url", "title")


@R.add("o03_page_after_id", views="items", sql="SELECT id, title FROM items WHERE id > 120 ORDER BY id LIMIT 50")
def o03(t: Tables) -> DataFrame:
    return catalog.after_id(t.items, 120, 50).select("id", "title")


# ------------------------------------------------------------------- sinks
@R.add("s11_rows_to_insert", views="feed_items items", sql=f"""
    SELECT id, url_normalized FROM (SELECT *, row_number() OVER (PARTITION BY url_normalized ORDER BY arrival_idx) AS rn FROM feed_items) f
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM items i WHERE i.published_at <= {AS_OF} - INTERVAL 24 HOUR AND i.url = f.url_normalized)""")
def s11(t: Tables) -> DataFrame:
    store = stored_before(t, 24).select(F.col("url").alias("url_normalized"))
    return sinks.rows_to_insert(feed_items(t), store, "url_normalized").select("id", "url_normalized")


@R.add("s12_without_keys", views="feed_items items", sql="""
    SELECT id FROM items i WHERE NOT EXISTS (SELECT 1 FROM feed_items f WHERE f.url_normalized = i.url)""")
def s12(t: Tables) -> DataFrame:
    gone = feed_items(t).select(F.col("url_normalized").alias("url"))
    return sinks.without_keys(t.items, gone).select("id")


@R.add("s13_evolved_schema", views="items", sql="""
    SELECT id, title, 'ru' AS language, NULL::VARCHAR AS ai_summary, 'none' AS published_confidence FROM items""")
def s13(t: Tables) -> DataFrame:
    old = t.items.select("id", "url", "title", "source")
    out = conform(old, "items", {"language": F.lit("ru"), "published_confidence": F.lit("none")})
    return out.select("id", "title", "language", "ai_summary", "published_confidence")


@R.add("s14_period_export", views="items", sql=f"""
    SELECT strftime(published_at, '%Y-%m-%d') AS "Дата", strftime(published_at, '%H:%M') AS "Время", source AS "Источник", url AS "Ссылка", title AS "Заголовок",
           trim({CONTENT}, ' ' || chr(10)) AS "Содержание новости", CASE WHEN {TAGS} <> '' THEN {TAGS} ELSE {CATEGORY_TAG} END AS "Хештеги"
    FROM items WHERE published_at > {AS_OF} - INTERVAL 24 HOUR""")
def s14(t: Tables) -> DataFrame:
    return gates.export_rows(health.recent(_tagged(t), "published_at", as_of(), 24))


@R.add("s15_digest", views="selections items", sql=f"""
    SELECT user_id, id, trim(title) AS title, trim(url) AS url,
      CASE category WHEN 'world' THEN '#Мир' WHEN 'russia' THEN '#Россия' WHEN 'moscow' THEN '#Москва' WHEN 'moscow_region' THEN '#Подмосковье'
        ELSE '#Россия' END AS tag,
      trim(regexp_replace(regexp_replace(regexp_replace(
        CASE WHEN id % 5 = 0 THEN 'summary ' || title WHEN id % 7 <> 0 AND clean_text <> '' THEN clean_text WHEN title <> '' THEN title ELSE 'Текст недоступен' END,
        '{lx.DIGEST_EMOJI_PATTERN}|{lx.DIGEST_SYMBOL_PATTERN}', '', 'g'), '(?i){lx.DIGEST_LABEL_PATTERN}', '', 'g'), '\\s+', ' ', 'g')) AS body
    FROM selections s JOIN items i ON i.id = s.news_id WHERE {{ENV}}""".replace("{ENV}", "(s.env IS NULL OR s.env = 'prod')"))
def s15(t: Tables) -> DataFrame:
    picked = routing.selections_with_items(t.selections, _tagged(t))
    return sinks.digest_rows(picked).drop("selected_at")


@R.add("s16_audit_report", sql="""
    SELECT 'degraded' AS overall_status, '{"documents":' || (SELECT count(*) FROM documents) || ',"events":' || (SELECT count(*) FROM events) || '}' AS table_counts""")
def s16(t: Tables) -> DataFrame:
    counts = audit.row_counts({n: t.raw(n) for n in ("documents", "events")})
    orphans = audit.orphans({"user_news_selections": (t.selections, "news_id", t.items, "id")})
    checks = counts.select(F.when(F.col("n") > 0, "WARNING").otherwise("ERROR").alias("status"))
    status = audit.overall_status(checks, F.count("*") > 0)
    report = sinks.audit_report(counts, orphans, status, as_of())
    return report.select("overall_status", F.to_json("table_counts").alias("table_counts"))


MID = "2024-01-16 00:00:00"


@R.add("s17_feed_state", views="fetch_log", sql=f"""
    WITH s AS (SELECT url, ts, id, CASE WHEN id % 4 <> 0 THEN 'W/' || id END AS etag, CASE WHEN id % 6 <> 0 THEN 'm' || id END AS last_modified FROM fetch_log)
    SELECT url, etag, last_modified FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC) AS rn FROM s
      WHERE ts < TIMESTAMP '{MID}' OR etag IS NOT NULL OR last_modified IS NOT NULL) WHERE rn = 1""")
def s17(t: Tables) -> DataFrame:
    """State of the first half of the month, updated by the responses of the second."""
    k = F.col("id")
    rows = t.fetch_log.select("url", "ts", F.when(k % 4 != 0, F.concat(F.lit("W/"), k.cast("string"))).alias("etag"),
                              F.when(k % 6 != 0, F.concat(F.lit("m"), k.cast("string"))).alias("last_modified"))
    middle = F.lit(MID).cast("timestamp")
    return sinks.upsert_feed_state(rows.filter(F.col("ts") < middle), rows.filter(F.col("ts") >= middle)).select("url", "etag", "last_modified")


@R.add("s19_updated_items", views="items", sql="""
    SELECT i.id, CASE WHEN l.doc_id IS NOT NULL THEN 'summary ' || l.doc_id WHEN i.id % 2 = 0 THEN 'old' END AS ai_summary
    FROM items i LEFT JOIN labels l ON l.doc_id + 1 = i.id""")
def s19(t: Tables) -> DataFrame:
    table = t.items.select("id", F.when(F.col("id") % 2 == 0, "old").alias("ai_summary"))
    fresh = t.raw("labels").select((F.col("doc_id") + 1).alias("id"), F.concat(F.lit("summary "), F.col("doc_id").cast("string")).alias("ai_summary"))
    return sinks.update_columns(table, fresh, "id", ["ai_summary"])


