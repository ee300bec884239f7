"""Delivery, selection, settings and invite queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.functions import urls
from newslake.functions.base import text
from newslake.operators import audit, gates, routing
from newslake.plans.registry import REGISTRY as R
from newslake.plans.views import AS_OF
from newslake.sources.adapters import Tables, as_of

DUCK_TS = "%Y-%m-%d %H:%M:%S.%f"
TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
OFF = "SELECT user_id, source_id FROM user_source_settings WHERE NOT enabled AND (env = 'prod' OR env IS NULL)"


def _candidates(t: Tables) -> DataFrame:
    """(user, item) pairs with the item's routing columns."""
    items = t.items.select(F.col("id").alias("news_id"), "source", "category", "doc_lang", F.length("clean_text").alias("n_chars"),
                           F.sha2("clean_text", 256).alias("checksum"))
    return t.selections.select("user_id", "news_id").join(items, "news_id")


@R.add("j07_orphans", views="user_source_settings sources selections items translation_cache", sql="""
    SELECT 'user_source_settings' AS table_name, count(*) AS orphans FROM user_source_settings u WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.id = u.source_id)
    UNION ALL SELECT 'user_news_selections', count(*) FROM selections u WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.id = u.news_id)
    UNION ALL SELECT 'translations', count(*) FROM translation_cache c WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.id = c.news_id)""")
def j07(t: Tables) -> DataFrame:
    return audit.orphans({
        "user_source_settings": (t.user_source_settings, "source_id", t.sources, "id"),
        "user_news_selections": (t.selections, "news_id", t.items, "id"),
        "translations": (t.translation_cache, "news_id", t.items, "id"),
    })


@R.add("j08_visible_items", views="selections items user_source_settings sources", sql=f"""
    SELECT p.user_id, p.news_id FROM selections p JOIN items i ON i.id = p.news_id WHERE NOT EXISTS (
      SELECT 1 FROM ({OFF}) o JOIN sources s ON s.id = o.source_id WHERE o.user_id = p.user_id AND s.code = i.source)""")
def j08(t: Tables) -> DataFrame:
    return routing.visible(_candidates(t).select("user_id", "news_id", "source"), t.user_source_settings, t.sources).select("user_id", "news_id")


ENABLED = f"""
    SELECT u.user_id, string_agg(s.id::VARCHAR, ',' ORDER BY s.id) FILTER (o.user_id IS NULL) AS source_ids
    FROM (SELECT DISTINCT user_id FROM source_toggles) u, sources s LEFT JOIN ({OFF}) o ON o.user_id = u.user_id AND o.source_id = s.id GROUP BY u.user_id"""


@R.add("j09_enabled_sources", views="source_toggles sources user_source_settings", sql=ENABLED)
def j09(t: Tables) -> DataFrame:
    out = routing.enabled_sources(t.source_toggles, t.user_source_settings, t.sources)
    return out.select("user_id", F.array_join(F.col("source_ids").cast("array<string>"), ",").alias("source_ids"))


@R.add("j10_enabled_map", views="source_toggles sources user_source_settings", sql="""
    SELECT u.user_id, s.id AS source_id, coalesce(o.enabled, TRUE) AS enabled FROM (SELECT DISTINCT user_id FROM source_toggles) u, sources s
    LEFT JOIN user_source_settings o ON o.user_id = u.user_id AND o.source_id = s.id AND (o.env = 'prod' OR o.env IS NULL)""")
def j10(t: Tables) -> DataFrame:
    return routing.enabled_map(t.source_toggles, t.user_source_settings, t.sources)


@R.add("j11_pending_backlog", views="items user_preferences", sql=f"""
    WITH n AS (SELECT u.user_id, u.category_filter, i.id, i.source, i.category, i.published_at,
                      row_number() OVER (PARTITION BY u.user_id ORDER BY i.id) AS rn
               FROM user_preferences u JOIN items i ON i.id > u.last_delivered_news_id)
    SELECT user_id, id, source, category FROM n WHERE rn <= 50 AND published_at >= {AS_OF} - INTERVAL 36 HOUR
      AND (category_filter IS NULL OR category_filter = category)""")
def j11(t: Tables) -> DataFrame:
    items = t.items.withColumn("domain", urls.item_domain(None, "url"))
    return routing.pending(items, t.user_preferences, as_of(), 50)


@R.add("j12_delivery_gate", views="selections items user_preferences user_source_settings sources delivery_log", sql=f"""
    SELECT p.user_id, p.news_id, CASE WHEN f.category_filter IS NOT NULL AND f.category_filter <> i.category THEN 'CATEGORY'
        WHEN coalesce(f.is_paused, FALSE) THEN 'PAUSED' WHEN coalesce(f.last_delivered_news_id, 0) > 0 AND p.news_id <= f.last_delivered_news_id THEN 'DUPLICATE'
        WHEN EXISTS (SELECT 1 FROM ({OFF}) o JOIN sources s ON s.id = o.source_id WHERE o.user_id = p.user_id AND s.code = i.source) THEN 'SOURCE_DISABLED'
        WHEN EXISTS (SELECT 1 FROM delivery_log d WHERE d.user_id = p.user_id AND d.news_id = p.news_id) THEN 'DUPLICATE' END AS skip_reason
    FROM selections p JOIN items i ON i.id = p.news_id
    LEFT JOIN user_preferences f ON f.user_id = p.user_id AND (f.env = 'prod' OR f.env IS NULL)""")
def j12(t: Tables) -> DataFrame:
    pairs = _candidates(t).select("user_id", "news_id", "source", "category")
    out = routing.delivery_decisions(pairs, t.user_preferences, t.user_source_settings, t.sources, t.delivery_log)
    return out.select("user_id", "news_id", "skip_reason")


@R.add("j13_new_deliveries", views="selections delivery_log", sql="""
    SELECT user_id, news_id FROM selections s WHERE NOT EXISTS (SELECT 1 FROM delivery_log d WHERE d.user_id = s.user_id AND d.news_id = s.news_id)""")
def j13(t: Tables) -> DataFrame:
    wanted = t.selections.select("user_id", "news_id", F.col("selected_at").alias("delivered_at"))
    return routing.new_deliveries(wanted.unionByName(wanted), t.delivery_log).select("user_id", "news_id")


@R.add("j14_undone_deliveries", views="selections delivery_log", sql="""
    SELECT user_id, news_id FROM delivery_log d WHERE NOT EXISTS (SELECT 1 FROM selections s WHERE d.user_id = s.user_id AND d.news_id = s.news_id)""")
def j14(t: Tables) -> DataFrame:
    return routing.undo_deliveries(t.delivery_log, t.selections).select("user_id", "news_id")


@R.add("j15_selected_items", views="selections items", sql=f"""
    SELECT s.user_id, s.news_id AS id, i.title, strftime(s.selected_at, '{DUCK_TS}') AS selected_at FROM selections s JOIN items i ON i.id = s.news_id
    WHERE s.env = 'prod' OR s.env IS NULL""")
def j15(t: Tables) -> DataFrame:
    rows = routing.selections_with_items(t.selections, t.items.select("id", "title"))
    return rows.orderBy("user_id", F.desc("selected_at")).select("user_id", "id", "title", F.date_format("selected_at", TS).alias("selected_at"))


@R.add("j16_selected_flag", views="delivery_log selections", sql="""
    SELECT d.user_id, d.news_id, EXISTS (SELECT 1 FROM selections s WHERE s.user_id = d.user_id AND s.news_id = d.news_id AND (s.env = 'prod' OR s.env IS NULL)) AS is_selected
    FROM delivery_log d""")
def j16(t: Tables) -> DataFrame:
    return routing.with_selected_flag(t.delivery_log.select("user_id", "news_id"), t.selections)


@R.add("j24_redeemed_invites", views="used_invites", sql="SELECT code, used_by, created_by FROM used_invites")
def j24(t: Tables) -> DataFrame:
    return routing.redeem_invites(t.invite_requests, t.invites)[0]


@R.add("j24b_approved_users", views="used_invites", sql="""
    SELECT used_by AS user_id, max_by(created_by, (ts, id)) AS invited_by FROM used_invites GROUP BY used_by""")
def j24b(t: Tables) -> DataFrame:
    return routing.redeem_invites(t.invite_requests, t.invites)[1]


@R.add("j25_translation_requests", views="selections items user_preferences translation_cache", sql="""
    SELECT DISTINCT i.id AS news_id, sha256(i.clean_text) AS checksum, coalesce(u.translate_lang, 'ru') AS target_lang
    FROM selections p JOIN items i ON i.id = p.news_id JOIN user_preferences u ON u.user_id = p.user_id AND (u.env = 'prod' OR u.env IS NULL) AND u.translate_enabled
    WHERE i.doc_lang = 'en' AND NOT EXISTS (SELECT 1 FROM translation_cache c WHERE c.news_id = i.id AND c.checksum = sha256(i.clean_text)
      AND c.target_lang = coalesce(u.translate_lang, 'ru'))""")
def j25(t: Tables) -> DataFrame:
    pairs = _candidates(t).withColumnRenamed("doc_lang", "language")
    return routing.translation_requests(pairs, t.user_preferences, t.translation_cache)


@R.add("w10_pause_states", views="preference_log", sql="""
    SELECT user_id, count(*) AS pause_version, max_by(is_paused, (ts, id)) AS is_paused FROM preference_log WHERE event_type = 'error' GROUP BY user_id""")
def w10(t: Tables) -> DataFrame:
    return routing.pause_states(t.preference_log)


@R.add("w11_delivery_watermarks", views="delivery_log", sql="""
    SELECT user_id, max_by(news_id, (delivered_at, news_id)) AS last_delivered_news_id FROM delivery_log GROUP BY user_id""")
def w11(t: Tables) -> DataFrame:
    return routing.delivery_watermarks(t.delivery_log)


@R.add("w12_source_pages", views="sources", sql="""
    SELECT id, title, (row_number() OVER (ORDER BY title, id) - 1) // 8 AS page, CAST(ceil(count(*) OVER () / 8.0) AS BIGINT) AS pages FROM sources""")
def w12(t: Tables) -> DataFrame:
    return routing.source_pages(t.sources, 8).select("id", "title", "page", F.col("pages").cast("bigint").alias("pages"))


@R.add("w13_toggle_parity", views="source_toggles", sql="""
    SELECT user_id, source_id, count(*) % 2 = 0 AS enabled FROM source_toggles GROUP BY user_id, source_id""")
def w13(t: Tables) -> DataFrame:
    return routing.current_toggles(t.source_toggles)


@R.add("w14_current_selections", views="selection_log", sql="""
    SELECT l.user_id, l.news_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, news_id ORDER BY ts DESC, id DESC) AS rn FROM selection_log WHERE action <> 'clear') l
    WHERE rn = 1 AND action = 'add' AND NOT EXISTS (SELECT 1 FROM selection_log c WHERE c.user_id = l.user_id AND c.action = 'clear' AND (c.ts, c.id) > (l.ts, l.id))""")
def w14(t: Tables) -> DataFrame:
    return routing.current_selections(t.selection_log)


@R.add("w15_current_preferences", views="preference_log", sql="""
    WITH u AS (SELECT DISTINCT user_id FROM preference_log),
    c AS (SELECT user_id, category_filter FROM preference_log WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) = 1),
    l AS (SELECT user_id, translate_enabled, translate_lang FROM preference_log WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) = 1)
    SELECT u.user_id, c.category_filter, coalesce(l.translate_enabled, FALSE) AS translate_enabled, coalesce(l.translate_lang, 'ru') AS translate_lang
    FROM u LEFT JOIN c ON c.user_id = u.user_id LEFT JOIN l ON l.user_id = u.user_id""")
def w15(t: Tables) -> DataFrame:
    return routing.current_preferences(t.preference_log)


@R.add("u02_enabled_difference", views="source_toggles sources user_source_settings", sql=f"""
    SELECT u.user_id, s.id AS source_id FROM (SELECT DISTINCT user_id FROM source_toggles) u, sources s
    WHERE (u.user_id, s.id) NOT IN (SELECT (user_id, source_id) FROM ({OFF}))""")
def u02(t: Tables) -> DataFrame:
    out = routing.enabled_sources(t.source_toggles, t.user_source_settings, t.sources)
    return out.select("user_id", F.explode("source_ids").alias("source_id"))


@R.add("u03_recipients", views="used_invites", sql="""
    WITH a AS (SELECT DISTINCT CAST(used_by AS BIGINT) AS user_id FROM used_invites)
    SELECT user_id FROM a UNION ALL SELECT DISTINCT n_nationkey::BIGINT FROM nation WHERE (SELECT count(*) FROM a) = 0""")
def u03(t: Tables) -> DataFrame:
    approved = routing.redeem_invites(t.invite_requests, t.invites)[1]
    return routing.recipients(approved, t.raw("nation").select(F.col("n_nationkey").alias("user_id"))).orderBy("user_id")


@R.add("u03b_recipients_fallback", views="used_invites", sql="""
    SELECT DISTINCT n_nationkey::BIGINT AS user_id FROM nation""")
def u03b(t: Tables) -> DataFrame:
    nobody = routing.redeem_invites(t.invite_requests, t.invites.withColumn("used_by", F.lit("taken")))[1]
    return routing.recipients(nobody, t.raw("nation").select(F.col("n_nationkey").alias("user_id")))


@R.add("a22_user_counts", views="selections used_invites invites", sql="""
    SELECT (SELECT count(*) FROM selections) AS selections, (SELECT count(DISTINCT used_by) FROM used_invites) AS approved_users,
           (SELECT count(*) FROM invites WHERE used_by IS NULL) AS open_invites""")
def a22(t: Tables) -> DataFrame:
    n = lambda df: df.agg(F.count("*")).scalar()
    approved = routing.redeem_invites(t.invite_requests, t.invites)[1]
    return t.selections.agg(F.count("*").alias("selections")).select(
        "selections", n(approved).alias("approved_users"), n(t.invites.filter(text("used_by") == "")).alias("open_invites"))


@R.add("p04_category_filter", views="user_preferences selections items", sql="""
    SELECT p.user_id, p.news_id FROM selections p JOIN items i ON i.id = p.news_id LEFT JOIN user_preferences u ON u.user_id = p.user_id
    WHERE u.category_filter IS NULL OR u.category_filter = i.category""")
def p04(t: Tables) -> DataFrame:
    rows = _candidates(t).join(t.user_preferences.select("user_id", "category_filter"), "user_id", "left")
    return rows.filter(gates.category_matches(F.col("category_filter"), F.col("category"))).select("user_id", "news_id")


@R.add("p23_env_scope", views="user_preferences", sql="SELECT user_id FROM user_preferences WHERE env = 'prod' OR env IS NULL")
def p23(t: Tables) -> DataFrame:
    return t.user_preferences.filter(gates.in_env(F.col("env"), "prod")).select("user_id")
