"""Health, usage, budget, cache and level queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.functions import urls
from newslake.operators import audit, gates, health, limits, ordered, usage
from newslake.plans.common import feed_items
from newslake.plans.registry import REGISTRY as R
from newslake.plans.views import AS_OF
from newslake.sources import catalog
from newslake.sources.adapters import Tables, as_of

TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DUCK_TS = "%Y-%m-%d %H:%M:%S.%f"


def _codes(t: Tables) -> DataFrame:
    return t.sources.select(F.col("code").alias("source"))


@R.add("a01_item_totals", views="items", sql=f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE published_at > {AS_OF} - INTERVAL 1 DAY) AS today FROM items""")
def a01(t: Tables) -> DataFrame:
    return health.item_totals(t.items, as_of())


@R.add("a02_counts_for_sources", views="sources source_events", sql="""
    SELECT s.code AS source, count(e.id) AS n FROM sources s
    LEFT JOIN source_events e ON e.source = s.code AND e.event_type = 'drop_old' GROUP BY s.code""")
def a02(t: Tables) -> DataFrame:
    return health.counts_for_sources(t.source_events.filter("event_type = 'drop_old'"), _codes(t))


@R.add("a03_counts_by_source", views="items", sql="SELECT source, count(*) AS n FROM items GROUP BY source ORDER BY n DESC, source")
def a03(t: Tables) -> DataFrame:
    return health.counts_by_source(t.items)


@R.add("a04_source_event_counts", views="event_counts", sql="SELECT * FROM event_counts")
def a04(t: Tables) -> DataFrame:
    return health.event_counts(t.source_events, _codes(t), as_of(), 24)


@R.add("a05_health_snapshot", views="source_events", sql=f"""
    SELECT source, strftime(max(created_at) FILTER (event_type = 'success'), '{DUCK_TS}') AS last_success_at,
           strftime(max(created_at) FILTER (event_type = 'error'), '{DUCK_TS}') AS last_error_at,
           max_by(error_code, (created_at, id)) FILTER (event_type = 'error') AS last_error_code,
           max_by(error_message, (created_at, id)) FILTER (event_type = 'error') AS last_error_message
    FROM source_events WHERE event_type IN ('success', 'error') GROUP BY source""")
def a05(t: Tables) -> DataFrame:
    return health.health_snapshot(t.source_events).withColumns(
        {c: F.date_format(c, TS) for c in ("last_success_at", "last_error_at")})


BOARD = f"""
    SELECT c.*, h.last_error_code, d.drop_code FROM event_counts c
    LEFT JOIN (SELECT source, max_by(error_code, (created_at, id)) AS last_error_code FROM source_events
               WHERE event_type = 'error' GROUP BY source) h ON h.source = c.source
    LEFT JOIN (SELECT source, max_by(error_code, (created_at, id)) AS drop_code FROM source_events
               WHERE event_type = 'drop_date' AND created_at >= {AS_OF} - INTERVAL 24 HOUR GROUP BY source) d ON d.source = c.source"""
RATE = "CASE WHEN success_count + error_count > 0 THEN error_count::DOUBLE / (success_count + error_count) ELSE 0.0 END"


@R.add("a10_error_rate_status", views="event_counts source_events", sql=f"""
    SELECT source, round({RATE}, 6) AS error_rate,
           CASE WHEN success_count > 0 AND {RATE} < 0.5 THEN 'green' WHEN error_count > 0 THEN 'red' ELSE 'yellow' END AS colour
    FROM event_counts""")
def a10(t: Tables) -> DataFrame:
    board = health.event_counts(t.source_events, _codes(t), as_of(), 24).withColumns(
        {"last_error_code": F.lit(None).cast("string"), "drop_code": F.lit(None).cast("string")})
    return health.with_status(board).select("source", F.round("error_rate", 6).alias("error_rate"), "colour")


@R.add("j06_last_drop_codes", views="source_events", sql=f"""
    SELECT source, max_by(error_code, (created_at, id)) AS error_code FROM source_events
    WHERE event_type = 'drop_date' AND created_at >= {AS_OF} - INTERVAL 24 HOUR GROUP BY source""")
def j06(t: Tables) -> DataFrame:
    return health.last_drop_codes(t.source_events, as_of(), 24)


@R.add("j17_status_board", views="event_counts source_events", sql=f"""
    SELECT source, success_count, error_count, drop_old_count, drop_date_count, last_error_code, drop_code,
           round({RATE}, 6) AS error_rate,
           CASE WHEN success_count > 0 AND {RATE} < 0.5 THEN 'green' WHEN error_count > 0 THEN 'red' ELSE 'yellow' END AS colour,
           CASE WHEN success_count > 0 AND {RATE} < 0.5 THEN success_count || ' новости (24ч)'
                WHEN error_count > 0 THEN coalesce(last_error_code, 'FETCH_ERROR') WHEN drop_old_count > 0 THEN 'OLD_PUBLISHED_AT'
                WHEN drop_date_count > 0 THEN coalesce(drop_code, 'NO_PUBLISHED_DATE') ELSE 'FETCH_OK_NO_MATCH' END AS status
    FROM ({BOARD})""")
def j17(t: Tables) -> DataFrame:
    return health.status_board(_codes(t), t.source_events, as_of(), 24).withColumn("error_rate", F.round("error_rate", 6))


def _rejected(t: Tables) -> DataFrame:
    return gates.with_freshness(t.items.withColumn("domain", urls.item_domain(None, "url")), as_of())


REASON = f"CASE WHEN published_at < {AS_OF} - INTERVAL 36 HOUR THEN 'OLD_PUBLISHED_AT' END"


@R.add("a15_drops_by_domain", views="items", sql=f"""
    SELECT domain, reason, count(*) AS n FROM (SELECT source || '.example.com' AS domain, {REASON} AS reason FROM items)
    WHERE reason IS NOT NULL GROUP BY domain, reason""")
def a15(t: Tables) -> DataFrame:
    return health.drops_by_domain(_rejected(t))


@R.add("a16_keep_drop_counts", views="items", sql=f"""
    SELECT source, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS kept,
           count(*) FILTER (WHERE reason IS NOT NULL) AS dropped
    FROM (SELECT source, {REASON} AS reason FROM items) GROUP BY source""")
def a16(t: Tables) -> DataFrame:
    return health.keep_drop_counts(_rejected(t))


@R.add("a16b_silent_sources", views="sources source_events", sql=f"""
    SELECT code AS source FROM sources WHERE code NOT IN (
      SELECT source FROM source_events WHERE event_type = 'drop_old' AND created_at >= {AS_OF} - INTERVAL 12 HOUR)""")
def a16b(t: Tables) -> DataFrame:
    late = health.recent(t.source_events.filter("event_type = 'drop_old'"), "created_at", as_of(), 12, inclusive=True)
    return health.silent_sources(_codes(t), late)


@R.add("a17_collected_counts", views="sources items", sql=f"""
    SELECT s.code AS source, count(i.id) AS n FROM sources s
    LEFT JOIN items i ON i.source = s.code AND i.published_at > {AS_OF} - INTERVAL 12 HOUR GROUP BY s.code""")
def a17(t: Tables) -> DataFrame:
    return catalog.collected_counts(_codes(t), health.recent(t.items, "published_at", as_of(), 12))


@R.add("a18_tick_stats", views="items", sql=f"""
    SELECT tick_id, fetched, published, fetched - published AS deduped FROM (
      SELECT strftime(fetched_at, '%Y-%m-%d %H') AS tick_id, count(*) AS fetched,
             count(*) FILTER (WHERE published_at >= {AS_OF} - INTERVAL 36 HOUR) AS published FROM items GROUP BY 1)""")
def a18(t: Tables) -> DataFrame:
    rows = _rejected(t).select(F.date_format("fetched_at", "yyyy-MM-dd HH").alias("tick_id"), F.col("reason").isNull().alias("published"))
    return audit.tick_stats(rows)


@R.add("w04_error_streaks", views="fetch_log", sql=f"""
    WITH f AS (SELECT *, lag(ts) OVER w AS prev FROM fetch_log WHERE failed WINDOW w AS (PARTITION BY url ORDER BY ts, id)),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 600000000 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY url ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS seg FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY url, seg ORDER BY ts, id) AS streak_no FROM g)
    SELECT id, url, streak_no, streak_no % 3 = 0 AS fires,
           strftime(CASE WHEN streak_no % 3 = 0 THEN ts + INTERVAL 900 SECOND END, '{DUCK_TS}') AS until FROM r""")
def w04(t: Tables) -> DataFrame:
    return health.error_streaks(t.fetch_log.filter("failed").select("id", "url", "ts")).select(
        "id", "url", F.col("streak_no").cast("bigint").alias("streak_no"), "fires", F.date_format("until", TS).alias("until"))


@R.add("w05_cooldown_state", views="fetch_log", sql=f"""
    WITH c AS (SELECT *, CASE WHEN kind = 'rss' THEN CASE status WHEN 403 THEN 1800 WHEN 404 THEN 3600 WHEN 429 THEN 300 WHEN 503 THEN 300 END
                              ELSE CASE status WHEN 403 THEN 600 WHEN 429 THEN 600 END END AS secs FROM fetch_log),
    f AS (SELECT *, lag(ts) OVER w AS prev FROM fetch_log WHERE failed WINDOW w AS (PARTITION BY url ORDER BY ts, id)),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 600000000 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY url ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS seg FROM f),
    r AS (SELECT id, row_number() OVER (PARTITION BY url, seg ORDER BY ts, id) AS streak_no FROM g),
    s AS (SELECT c.*, CASE WHEN streak_no % 3 = 0 THEN ts + INTERVAL 900 SECOND ELSE ts + to_seconds(secs) END AS sets FROM c LEFT JOIN r USING (id)),
    l AS (SELECT *, last_value(sets IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM s)
    SELECT id, url, strftime(until, '{DUCK_TS}') AS until, coalesce(until > ts, FALSE) AS in_cooldown FROM l""")
def w05(t: Tables) -> DataFrame:
    return health.cooldown_states(t.fetch_log).select("id", "url", F.date_format("until", TS).alias("until"), "in_cooldown")


@R.add("p16_error_codes", views="fetch_log", sql="""
    SELECT id, CASE WHEN status IS NOT NULL THEN 'HTTP_' || status WHEN lower(error) LIKE '%timeout%' THEN 'TIMEOUT'
                    WHEN lower(error) LIKE '%dns%' THEN 'CONNECTION_ERROR' WHEN lower(error) LIKE '%parse%' THEN 'PARSE_ERROR'
                    ELSE 'FETCH_ERROR' END AS error_code
    FROM fetch_log WHERE failed""")
def p16(t: Tables) -> DataFrame:
    return t.fetch_log.filter("failed").select("id", health.error_code(F.col("status"), F.col("error")).alias("error_code"))


# ------------------------------------------------------------------ usage
@R.add("a06_cache_stats", views="response_cache", sql=f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE expires_at > {AS_OF}) AS active,
           count(*) FILTER (WHERE expires_at <= {AS_OF}) AS expired FROM response_cache""")
def a06(t: Tables) -> DataFrame:
    return usage.cache_stats(t.response_cache, as_of())


@R.add("a07_expired_purge", views="response_cache", sql=f"""
    SELECT count(*) FILTER (WHERE expires_at < {AS_OF}) AS deleted, count(*) FILTER (WHERE expires_at >= {AS_OF}) AS kept FROM response_cache""")
def a07(t: Tables) -> DataFrame:
    kept, deleted = usage.purge_expired(t.response_cache, as_of())
    return deleted.withColumn("kept", kept.agg(F.count("*")).scalar())


@R.add("a08_usage_totals", views="usage_log", sql="""
    SELECT count(*) AS total_requests, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens, round(sum(cost_usd), 6) AS total_cost_usd,
""" + ",\n".join(f"""count(*) FILTER (WHERE operation = '{o}') AS {o}_requests,
           CAST(coalesce(sum(tokens_in + tokens_out) FILTER (operation = '{o}'), 0) AS BIGINT) AS {o}_tokens""" for o in usage.OPERATIONS) + " FROM usage_log")
def a08(t: Tables) -> DataFrame:
    return usage.usage_totals(t.usage_log).withColumn("total_cost_usd", F.round("total_cost_usd", 6))


@R.add("a09_daily_usage", views="daily_usage", sql="SELECT * REPLACE (round(cost_usd, 6) AS cost_usd) FROM daily_usage")
def a09(t: Tables) -> DataFrame:
    return usage.daily_usage(t.usage_log).withColumn("cost_usd", F.round("cost_usd", 6))


@R.add("a11_budget_state", views="daily_usage", sql="""
    SELECT date, CASE WHEN tokens_in + tokens_out + 20 >= 3000 OR cost_usd >= 0.00085 - 0.00025 THEN 'DEGRADED' ELSE 'OK' END AS budget_state,
           CASE WHEN tokens_in + tokens_out + 20 >= 3000 OR cost_usd >= 0.00085 - 0.00025 THEN 'cleanup,hashtags_ai,summary' ELSE '' END AS degraded
    FROM daily_usage""")
def a11(t: Tables) -> DataFrame:
    state = usage.budget_state(usage.daily_usage(t.usage_log), 0.00085, 0.00025, 3000, 20)
    return state.select("date", "budget_state", F.array_join("degraded_features", ",").alias("degraded"))


@R.add("a12_spend_mode", views="daily_usage", sql="""
    SELECT date, CASE WHEN cost_usd >= 0.0007 THEN 'block' WHEN cost_usd >= 0.0007 * 0.9 THEN 'warning'
                      WHEN cost_usd >= 0.0007 * 0.8 THEN 'economy' ELSE 'normal' END AS mode FROM daily_usage""")
def a12(t: Tables) -> DataFrame:
    return usage.spend_mode(usage.daily_usage(t.usage_log), 0.0007).select("date", "mode")


@R.add("a13_split_cost", views="usage_log", sql="""
    SELECT round(floor(n * 0.6) / 1000000.0 * 0.14 + floor(n * 0.4) / 1000000.0 * 0.28, 6) AS estimated_cost
    FROM (SELECT sum(tokens_in + tokens_out)::DOUBLE AS n FROM usage_log)""")
def a13(t: Tables) -> DataFrame:
    return usage.usage_totals(t.usage_log).select(F.round(usage.split_cost(F.col("total_tokens")), 6).alias("estimated_cost"))


@R.add("a14_hit_rate", views="daily_usage", sql="""
    SELECT date, round(CASE WHEN calls > 0 THEN cache_hits::DOUBLE / calls * 100.0 ELSE 0.0 END, 6) AS hit_rate FROM daily_usage""")
def a14(t: Tables) -> DataFrame:
    return usage.daily_usage(t.usage_log).select("date", F.round(usage.hit_rate(F.col("cache_hits"), F.col("calls")), 6).alias("hit_rate"))


@R.add("a23_resynced_totals", views="usage_log", sql="""
    WITH b AS (SELECT max(ts) AS ts FROM usage_log WHERE operation = 'category' AND turn = 0)
    SELECT 626 + count(*) AS total_requests, 197947 + CAST(coalesce(sum(tokens_in + tokens_out), 0) AS BIGINT) AS total_tokens,
           round(0.02 + coalesce(sum(cost_usd), 0), 6) AS total_cost_usd
    FROM usage_log, b WHERE usage_log.ts > b.ts""")
def a23(t: Tables) -> DataFrame:
    base = t.usage_log.filter("operation = 'category' AND turn = 0").select(
        "ts", F.lit(626).alias("total_requests"), F.lit(197947).alias("total_tokens"), F.lit(0.02).alias("total_cost_usd"))
    out = usage.totals_since_baseline(t.usage_log, base)
    return out.select(F.col("total_requests").cast("bigint"), F.col("total_tokens").cast("bigint"), F.round("total_cost_usd", 6).alias("total_cost_usd"))


@R.add("u04_degraded_features", views="daily_usage", sql="""
    SELECT date, CASE WHEN calls > 20 AND cost_usd >= 0.0006 THEN 'cleanup,hashtags_ai,summary' WHEN cost_usd >= 0.0006 THEN 'cleanup,hashtags_ai,summary'
                      WHEN calls > 20 THEN 'summary,translate' ELSE '' END AS degraded FROM daily_usage WHERE NOT (calls > 20 AND cost_usd >= 0.0006)
    UNION ALL SELECT date, 'cleanup,hashtags_ai,summary,translate' FROM daily_usage WHERE calls > 20 AND cost_usd >= 0.0006""")
def u04(t: Tables) -> DataFrame:
    state = usage.budget_state(usage.daily_usage(t.usage_log), 0.0006, 0.0)
    gate = F.when(F.col("calls") > 20, F.array(F.lit("translate"), F.lit("summary"))).otherwise(F.array().cast("array<string>"))
    return state.select("date", F.array_join(usage.degraded_features(F.col("degraded_features"), gate), ",").alias("degraded"))


@R.add("p20_summary_eligibility", sql="""
    SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 AND text <> '' AND n < 200 THEN 'too_short' WHEN (conv_id + turn) % 6 = 0 THEN 'disabled'
           WHEN n < CASE WHEN turn % 3 = 0 THEN 20 ELSE 200 END THEN 'too_short' END AS reason
    FROM (SELECT *, length(trim(text, ' ' || chr(10))) AS n FROM conversations)""")
def p20(t: Tables) -> DataFrame:
    level = (F.col("conv_id") + F.col("turn")) % 6
    return t.raw("conversations").select(
        "conv_id", "turn", gates.summary_eligibility(F.col("text"), level, F.col("turn") % 3 == 0).alias("reason"))


@R.add("p21_token_estimate", sql="""
    SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens,
           round(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END * 0.00014::DOUBLE / 1000 + 50 * 0.00028::DOUBLE / 1000, 9) AS cost
    FROM conversations""")
def p21(t: Tables) -> DataFrame:
    n = gates.estimate_tokens(F.col("text"))
    return t.raw("conversations").select(
        "conv_id", "turn", n.cast("bigint").alias("tokens"), F.round(gates.token_cost(n, F.lit(50)), 9).alias("cost"))


@R.add("j21_cache_lookup", views="response_cache", sql=f"""
    WITH r AS (SELECT doc_id AS request_id, md5(text) AS cache_key FROM documents
               UNION ALL SELECT -1 - item_id, md5(text) FROM benchmark)
    SELECT r.request_id, c.cache_key IS NOT NULL AS cache_hit, c.input_tokens, c.output_tokens
    FROM r LEFT JOIN response_cache c ON c.cache_key = r.cache_key AND c.expires_at > {AS_OF}""")
def j21(t: Tables) -> DataFrame:
    requests = t.documents.select(F.col("doc_id").alias("request_id"), F.md5("text").alias("cache_key")).unionByName(
        t.raw("benchmark").select((-1 - F.col("item_id")).alias("request_id"), F.md5("text").alias("cache_key")))
    return usage.cache_lookup(requests, t.response_cache, as_of()).select("request_id", "cache_hit", "input_tokens", "output_tokens")


@R.add("j22_translation_cache", views="items translation_cache", sql="""
    SELECT i.id AS news_id, c.translated_text FROM items i LEFT JOIN translation_cache c
      ON c.news_id = i.id AND c.checksum = sha256(i.clean_text) AND c.target_lang = 'ru'""")
def j22(t: Tables) -> DataFrame:
    need = t.items.select(F.col("id").alias("news_id"), F.sha2("clean_text", 256).alias("checksum"), F.lit("ru").alias("target_lang"))
    return usage.cached_translations(need, t.translation_cache).select("news_id", "translated_text")


@R.add("j23_reusable_summaries", views="items", sql=f"""
    SELECT doc_id + 1 AS id, 'summary ' || doc_id AS ai_summary FROM labels
    WHERE quality = 1 AND {AS_OF} - to_minutes(CAST(doc_id % 150 AS INTEGER)) > {AS_OF} - INTERVAL 1 HOUR""")
def j23(t: Tables) -> DataFrame:
    done = t.raw("labels").filter("quality = 1").select(
        (F.col("doc_id") + 1).alias("id"), F.concat(F.lit("summary "), F.col("doc_id").cast("string")).alias("ai_summary"),
        (as_of() - F.make_dt_interval(mins=(F.col("doc_id") % 150).cast("int"))).alias("ai_summary_created_at"))
    items = t.items.select("id").join(done, "id", "left")
    return usage.reusable_summaries(items, as_of()).select("id", "ai_summary")


@R.add("s20_upsert_cache", views="response_cache", sql=f"""
    WITH n AS (SELECT cache_key, 'renewed' AS task_type, TIMESTAMP '2024-01-30 12:00:00' AS created_at,
                      TIMESTAMP '2024-02-02 12:00:00' AS expires_at FROM response_cache WHERE expires_at < {AS_OF})
    SELECT cache_key, task_type, strftime(expires_at, '{DUCK_TS}') AS expires_at FROM (
      SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, src DESC) AS rn FROM (
        SELECT cache_key, task_type, created_at, expires_at, 0 AS src FROM response_cache
        UNION ALL SELECT cache_key, task_type, created_at, expires_at, 1 FROM n)) WHERE rn = 1""")
def s20(t: Tables) -> DataFrame:
    """Expired responses are renewed."""
    table = t.response_cache.select("cache_key", "task_type", "created_at", "expires_at")
    new = table.filter(F.col("expires_at") < as_of()).select(
        "cache_key", F.lit("renewed").alias("task_type"), F.lit("2024-01-30 12:00:00").cast("timestamp").alias("created_at"))
    out = usage.upsert(table, usage.with_expiry(new), ["cache_key"], ["created_at"])
    return out.select("cache_key", "task_type", F.date_format("expires_at", TS).alias("expires_at"))


# ----------------------------------------------------------------- levels
LEVEL = "CASE WHEN try_cast(v AS INTEGER) IS NOT NULL THEN greatest(0, least(5, try_cast(v AS INTEGER))) END"


@R.add("j18_effective_level", views="settings user_preferences", sql=f"""
    SELECT user_id, CAST(coalesce({LEVEL}, 4, 3) AS INTEGER) AS level FROM (
      SELECT u.user_id, s.value AS v FROM user_preferences u
      LEFT JOIN settings s ON s.scope = u.user_id AND s.key = 'ai_summary_level')""")
def j18(t: Tables) -> DataFrame:
    return usage.effective_levels(t.user_preferences, t.settings, "summary")


MIGRATED = f"""
    SELECT user_id, CAST(CASE WHEN v IS NOT NULL THEN coalesce({LEVEL}, 3) WHEN e IS NOT NULL THEN CASE WHEN e IN ('1', 'true') THEN 3 ELSE 0 END
                         ELSE 3 END AS INTEGER) AS level FROM (
      SELECT u.user_id, s.value AS v, f.value AS e FROM user_preferences u
      LEFT JOIN settings s ON s.scope = u.user_id AND s.key = 'ai_summary_level'
      LEFT JOIN settings f ON f.scope = u.user_id AND f.key = 'ai_summary_enabled')"""


@R.add("j19_migrated_level", views="settings user_preferences", sql=MIGRATED)
def j19(t: Tables) -> DataFrame:
    return usage.migrated_levels(t.user_preferences, t.settings, "summary")


@R.add("j20_level_profile", views="settings user_preferences", sql=f"""
    SELECT user_id, level, level <= 0 AS disabled, p.max_tokens, p.temperature, p.top_p FROM ({MIGRATED}) u
    LEFT JOIN (VALUES (1, 200, 0.5::DOUBLE, 0.9::DOUBLE), (2, 300, 0.6, 0.95), (3, 400, 0.7, 0.95), (4, 600, 0.7, 0.98), (5, 800, 0.8, 0.99))
      p(l, max_tokens, temperature, top_p) ON p.l = CASE WHEN level > 0 THEN least(5, level) END""")
def j20(t: Tables) -> DataFrame:
    rows = usage.migrated_levels(t.user_preferences, t.settings, "summary")
    return usage.with_profile(rows, F.lit("summary")).select("user_id", "level", "disabled", "max_tokens", "temperature", "top_p")


# ------------------------------------------------------------------- gates
@R.add("w06_rate_limit", views="rate_limited", sql="SELECT * FROM rate_limited")
def w06(t: Tables) -> DataFrame:
    return limits.rate_limited(t.user_requests, 3, 60).select("user_id", "id", "accepted")


@R.add("w07_tick_gate", sql="""
    WITH c AS (SELECT conv_id // 3 AS tick_id, conv_id * 100 + turn AS call_no,
                 ['summary', 'cleanup', 'hashtags_ai', 'translate'][(conv_id + turn) % 4 + 1] AS task FROM conversations),
    n AS (SELECT *, row_number() OVER (PARTITION BY tick_id ORDER BY call_no) AS rn FROM c),
    f AS (SELECT tick_id, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list([task] ORDER BY call_no)), lambda off, r:
            CASE WHEN len(off) < 3 AND NOT list_contains(off, r[1]) THEN list_append(off, ['summary', 'cleanup', 'hashtags_ai'][len(off) + 1]) ELSE off END) AS off
          FROM n WHERE rn > 6 GROUP BY tick_id)
    SELECT tick_id, count(*) FILTER (WHERE rn <= 6) AS allowed, count(*) FILTER (WHERE rn > 6) AS refused,
           coalesce(array_to_string(list_sort(any_value(off)), ','), '') AS disabled
    FROM n LEFT JOIN f USING (tick_id) GROUP BY tick_id""")
def w07(t: Tables) -> DataFrame:
    gated = limits.gate_calls(t.calls, 6).groupBy("tick_id").agg(
        F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))
    off = limits.disabled_tasks(t.calls, 6)
    return gated.join(off, "tick_id", "left").select(
        "tick_id", "allowed", "refused", F.array_join(F.coalesce("disabled", F.array().cast("array<string>")), ",").alias("disabled"))


# ------------------------------------------------------------------- audit
@R.add("a19_row_counts", sql="""
    SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events
    UNION ALL SELECT 'pages', count(*) FROM pages""")
def a19(t: Tables) -> DataFrame:
    return audit.row_counts({n: t.raw(n) for n in ("documents", "events", "pages")})


@R.add("a20_completeness", views="feed_items", sql="""
    SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(title, '') = '') AS missing_title,
           count(*) FILTER (WHERE coalesce(url, '') = '') AS missing_url, count(*) FILTER (WHERE coalesce(guid, '') = '') AS missing_guid
    FROM feed_items""")
def a20(t: Tables) -> DataFrame:
    return audit.completeness(feed_items(t), ["title", "url", "guid"])


def _checks(t: Tables) -> DataFrame:
    board = health.status_board(_codes(t), t.source_events, as_of(), 24)
    return board.select(F.when(F.col("colour") == "red", "ERROR").when(F.col("colour") == "yellow", "WARNING").otherwise("OK").alias("status"))


LOG_SQL = """
    SELECT file, count(*) FILTER (WHERE level = 'ERROR') AS errors, count(*) FILTER (WHERE level = 'WARNING') AS warnings FROM (
      SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS rn FROM log_lines) WHERE rn <= 500 GROUP BY file"""


@R.add("a21_overall_status", views="event_counts log_lines", sql=f"""
    WITH c AS (SELECT CASE WHEN success_count > 0 AND {RATE} < 0.5 THEN 'green' WHEN error_count > 0 THEN 'red' ELSE 'yellow' END AS colour FROM event_counts),
    l AS ({LOG_SQL}), s AS (SELECT sum(errors) AS e, sum(warnings) AS w FROM l)
    SELECT errors, warnings, CASE WHEN NOT core_ok THEN 'critical' WHEN errors > 0 OR warnings > 0 THEN 'degraded' ELSE 'normal' END AS overall_status
    FROM (SELECT CAST(count(*) FILTER (WHERE colour = 'red') + (SELECT CASE WHEN e > 0 THEN e ELSE 0 END FROM s) AS BIGINT) AS errors,
                 CAST(count(*) FILTER (WHERE colour = 'yellow') + (SELECT CASE WHEN e > 0 THEN w ELSE 0 END FROM s) AS BIGINT) AS warnings, count(*) > 0 AS core_ok FROM c)""")
def a21(t: Tables) -> DataFrame:
    log = audit.log_summary(t.log_lines)
    return audit.overall_status(_checks(t), F.count("*") > 0, log).select("errors", "warnings", "overall_status")


@R.add("s18_log_scan", views="log_lines", sql=LOG_SQL)
def s18(t: Tables) -> DataFrame:
    return audit.log_summary(t.log_lines)


@R.add("w03_latest_per_key", views="source_events", sql="""
    SELECT source, id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id DESC) AS rn FROM source_events) WHERE rn = 1""")
def w03(t: Tables) -> DataFrame:
    return ordered.latest_row(t.source_events, ["source"], ["created_at", "id"]).select("source", "id", "event_type")


