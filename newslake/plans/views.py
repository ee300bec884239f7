"""The canonical tables in SQL: the same projections as ``newslake.sources.adapters``."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

# name: (views it reads, SELECT)
VIEWS: dict[str, tuple[list[str], str]] = {
    "items": ([], """
        SELECT doc_id + 1 AS id, doc_id AS arrival_idx,
               'https://' || source || '.example.com/item/' || doc_id AS url,
               split_part(text, chr(10), 1) AS title, source,
               CASE doc_id % 4 WHEN 0 THEN 'world' WHEN 1 THEN 'russia' WHEN 2 THEN 'moscow' ELSE 'moscow_region' END AS category,
               text AS clean_text,
               TIMESTAMP '2024-01-30 23:59:00' - to_hours(CAST(doc_id % 72 AS INTEGER)) AS published_at, lang AS doc_lang,
               'https://' || source || '.example.com/item/' || doc_id AS guid,
               TIMESTAMP '2024-01-30 23:59:00' - to_hours(CAST(doc_id % 72 AS INTEGER)) + INTERVAL 5 MINUTE AS fetched_at
        FROM documents"""),
    "feed_entries": ([], """
        SELECT *, CASE WHEN doc_id % 37 = 5 THEN '' ELSE 'HTTPS://' || upper(source) || '.Example.com:443/item/' || linked
                 || CASE WHEN doc_id % 3 = 1 THEN '/?utm_source=rss&b=2&a=1#frag' ELSE '/?utm_source=rss#frag' END END AS link,
               CASE doc_id % 3 WHEN 0 THEN 'https://' || source || '.example.com/item/' || linked
                 WHEN 2 THEN 'HTTPS://' || upper(source) || '.Example.com:443/item/' || linked || '/?utm_source=rss#frag' END AS guid,
               CASE WHEN doc_id % 37 = 5 THEN '' ELSE 'https://' || source || '.example.com/item/' || linked
                 || CASE WHEN doc_id % 3 = 1 THEN '?a=1&b=2' ELSE '' END END AS canonical
        FROM (SELECT doc_id, doc_id AS entry_id, source, 'https://' || source || '.example.com/rss' AS feed_url, doc_id // 20 AS pos,
               CASE WHEN doc_id % 50 <> 7 THEN split_part(text, chr(10), 1) END AS title, text AS summary,
               TIMESTAMP '2024-01-30 23:59:00' - to_hours(CAST(doc_id % 72 AS INTEGER)) AS stamp,
               CASE WHEN (doc_id // 20) % 3 = 2 THEN doc_id - 20 ELSE doc_id END AS linked
        FROM documents)"""),
    "feed_items": (["feed_entries"], r"""
        SELECT entry_id AS id, entry_id AS arrival_idx, title, link AS url, guid, canonical AS url_normalized,
               CASE WHEN canonical <> '' THEN sha256(canonical) ELSE '' END AS url_hash, sha256(summary) AS checksum,
               regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{N}_\s]', '', 'g') AS flat
        FROM feed_entries"""),
    "sources": ([], """
        SELECT DISTINCT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) + 1 AS id, source AS code,
               'Source ' || upper(source) AS title, TRUE AS enabled_global
        FROM documents"""),
    "source_events": ([], """
        SELECT event_id AS id, 'src' || (user_id % 20) AS source,
               CASE WHEN event_type IN ('click', 'purchase') THEN 'success' WHEN event_type = 'error' THEN 'error'
                    WHEN event_type = 'signup' THEN 'drop_old' ELSE 'drop_date' END AS event_type,
               CASE WHEN event_type IN ('error', 'view') THEN 'E' || json_extract_string(props, '$.k') END AS error_code,
               CASE WHEN event_type = 'error' THEN 'fetch failed with code ' || json_extract_string(props, '$.k') END AS error_message,
               ts AS created_at
        FROM events"""),
    "fetch_log": ([], """
        SELECT event_id AS id, 'https://src' || (user_id % 20) || '.example.com/rss' AS url, 'src' || (user_id % 20) AS source,
               CASE WHEN user_id % 2 = 0 THEN 'rss' ELSE 'html' END AS kind,
               CASE WHEN event_type = 'error' AND k % 6 < 4 THEN CASE k % 6 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 429 ELSE 503 END
                    WHEN event_type <> 'error' THEN 200 END AS status,
               CASE WHEN event_type = 'error' AND k % 6 = 4 THEN CASE WHEN k % 4 = 0 THEN 'Read Timeout' ELSE 'cannot parse the document' END
                    WHEN event_type = 'error' AND k % 6 = 5 THEN CASE WHEN k % 4 = 1 THEN 'DNS lookup failed' ELSE 'boom' END END AS error,
               event_type = 'error' AS failed, ts
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""),
    "source_toggles": ([], """
        SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, event_id % 23 + 1 AS source_id, ts FROM events"""),
    "user_source_settings": (["source_toggles"], """
        SELECT user_id, source_id, count(*) % 2 = 0 AS enabled,
               CASE WHEN max(id) % 11 = 0 THEN NULL WHEN max(id) % 11 = 1 THEN 'sandbox' ELSE 'prod' END AS env
        FROM source_toggles GROUP BY user_id, source_id"""),
    "delivery_log": ([], """
        SELECT CAST(user_id AS VARCHAR) AS user_id, event_id % ((SELECT count(*) FROM documents) + 50) + 1 AS news_id, min(ts) AS delivered_at
        FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"""),
    "selections": ([], """
        SELECT user_id, news_id, min(ts) AS selected_at,
               CASE WHEN news_id % 13 = 0 THEN NULL WHEN news_id % 13 = 1 THEN 'sandbox' ELSE 'prod' END AS env
        FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, event_id % ((SELECT count(*) FROM documents) + 50) + 1 AS news_id, ts
              FROM events WHERE event_type = 'click') GROUP BY user_id, news_id"""),
    "selection_log": ([], """
        SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type <> 'signup' THEN event_id % 40 + 1 END AS news_id,
               CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'remove' ELSE 'clear' END AS action, ts
        FROM events WHERE event_type IN ('click', 'view', 'signup')"""),
    "preference_log": ([], """
        SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, ts, event_type,
               CASE WHEN event_type = 'click' THEN CASE event_id % 3 WHEN 0 THEN 'world' WHEN 1 THEN 'moscow' END END AS category_filter,
               CASE WHEN event_type = 'view' THEN event_id % 2 = 0 END AS translate_enabled,
               CASE WHEN event_type = 'view' THEN CASE event_id % 2 WHEN 0 THEN 'ru' ELSE 'en' END END AS translate_lang,
               CASE WHEN event_type = 'error' THEN event_id % 2 = 0 END AS is_paused
        FROM events"""),
    "log_lines": ([], """
        SELECT 'worker-' || (user_id % 4) || '.log' AS file, event_id AS line_no,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'INFO' END AS level
        FROM events"""),
    "user_preferences": ([], """
        SELECT CAST(c_custkey AS VARCHAR) AS user_id,
               CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'sandbox' ELSE 'prod' END AS env,
               c_custkey % 7 = 0 AS is_paused, c_custkey % 100 AS last_delivered_news_id, c_custkey % 3 AS pause_version,
               c_custkey % 3 = 0 AS translate_enabled, CASE WHEN c_custkey % 2 = 0 THEN 'ru' END AS translate_lang,
               CASE c_custkey % 5 WHEN 1 THEN 'world' WHEN 2 THEN 'russia' WHEN 3 THEN 'moscow' WHEN 4 THEN 'moscow_region' END AS category_filter
        FROM customer"""),
    "invites": ([], """
        SELECT 'inv' || s_suppkey AS code, CAST(s_nationkey AS VARCHAR) AS created_by,
               CASE WHEN s_suppkey % 4 = 0 THEN 'someone' END AS used_by,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(s_suppkey % 700 AS INTEGER)) AS created_at
        FROM supplier"""),
    "invite_requests": ([], """
        SELECT o_orderkey AS id, 'inv' || (o_orderkey % 150) AS code, CAST(o_custkey AS VARCHAR) AS user_id,
               TIMESTAMP '2024-01-02 00:00:00' + to_seconds((o_orderkey * 7919) % 100000) AS ts
        FROM orders"""),
    "used_invites": (["invites", "invite_requests"], """
        SELECT r.code, r.user_id AS used_by, i.created_by, r.ts, r.id
        FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, id) AS rn FROM invite_requests) r
        JOIN invites i ON i.code = r.code WHERE r.rn = 1 AND i.used_by IS NULL"""),
    "usage_log": ([], """
        SELECT *, tokens_in * 0.00000014::DOUBLE + tokens_out * 0.00000028::DOUBLE AS cost_usd FROM (
          SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) AS ts,
               CASE conv_id % 4 WHEN 0 THEN 'summarize' WHEN 1 THEN 'category' WHEN 2 THEN 'text_clean' ELSE 'translate' END AS operation,
               CASE WHEN role <> 'assistant' THEN length(text) // 4 ELSE 0 END AS tokens_in,
               CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS tokens_out,
               turn % 5 = 0 AS cache_hit, conv_id, turn FROM conversations)"""),
    "daily_usage": (["usage_log"], """
        SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
               sum(cost_usd) AS cost_usd, count(*) AS calls, count(*) FILTER (WHERE cache_hit) AS cache_hits
        FROM usage_log GROUP BY 1"""),
    "response_cache": ([], """
        SELECT md5(text) AS cache_key, CASE item_id % 3 WHEN 0 THEN 'summarize' WHEN 1 THEN 'category' ELSE 'text_clean' END AS task_type,
               text AS summary, length(text) // 4 AS input_tokens, item_id % 7 + 50 AS output_tokens, item_id,
               TIMESTAMP '2024-01-27 04:00:00' + to_hours(CAST(item_id AS INTEGER)) AS created_at,
               TIMESTAMP '2024-01-30 04:00:00' + to_hours(CAST(item_id AS INTEGER)) AS expires_at
        FROM benchmark"""),
    "translation_cache": ([], """
        SELECT d.doc_id + 1 AS news_id, CASE WHEN l.toxic = 1 THEN 'stale' ELSE sha256(d.text) END AS checksum, 'ru' AS target_lang,
               'translated ' || d.doc_id AS translated_text
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""),
    "settings": ([], """
        SELECT CAST(c_custkey AS VARCHAR) AS scope, 'ai_summary_level' AS key,
               CASE c_custkey % 16 WHEN 0 THEN '1' WHEN 4 THEN '9' WHEN 8 THEN 'bad' ELSE '-2' END AS value
        FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'ai_summary_enabled',
               CASE c_custkey % 16 WHEN 1 THEN '0' WHEN 5 THEN '1' WHEN 9 THEN 'true' ELSE 'off' END
        FROM customer WHERE c_custkey % 4 = 1
        UNION ALL SELECT 'global', 'ai_summary_level', '4'"""),
    # board of source status: counts in the last day, last codes
    "event_counts": (["sources", "source_events"], f"""
        SELECT s.code AS source, count(*) FILTER (WHERE e.event_type = 'success') AS success_count,
               count(*) FILTER (WHERE e.event_type = 'error') AS error_count,
               count(*) FILTER (WHERE e.event_type = 'drop_old') AS drop_old_count,
               count(*) FILTER (WHERE e.event_type = 'drop_date') AS drop_date_count
        FROM sources s LEFT JOIN source_events e ON e.source = s.code AND e.created_at >= {AS_OF} - INTERVAL 24 HOUR
        GROUP BY s.code"""),
    "titles": (["items"], r"""
        SELECT *, regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g') AS flat FROM items"""),
    "title_sets": (["titles"], r"""
        SELECT id, arrival_idx, published_at, norm, list_distinct(list_filter(string_split(norm, ' '),
               lambda w: length(w) > 2 AND w NOT IN ('в','на','из','за','по','до','с','к','у','о','и','а','но','что','как','это','для'))) AS words
        FROM (SELECT *, trim(regexp_replace(flat, '\s+', ' ', 'g')) AS norm FROM titles)"""),
    "user_requests": ([], """
        SELECT event_id AS id, CAST(user_id % 5 AS VARCHAR) AS user_id, 1704067200 + (epoch_us(ts) // 40000000) % 200000 AS sec FROM events"""),
    # the greedy limit, request by request: the state is the list of passed seconds that still count
    "rate_limited": (["user_requests"], """
        WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, id) AS rn FROM user_requests),
        s AS (SELECT user_id, id, rn, TRUE AS accepted, [sec] AS live FROM n WHERE rn = 1
          UNION ALL SELECT user_id, id, rn, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, sec) ELSE kept END
          FROM (SELECT n.*, list_filter(s.live, lambda x: n.sec - x < 60) AS kept FROM s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1))
        SELECT user_id, id, accepted FROM s"""),
    # fingerprints: one bit vote per word
    "simhashes": (["items"], r"""
        SELECT i.id, i.arrival_idx, i.published_at, f.simhash FROM items i LEFT JOIN (
          SELECT id, sum(CASE WHEN 2 * ones > n THEN CASE WHEN b = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << b END ELSE 0 END)::BIGINT AS simhash
          FROM (SELECT id, b, sum((v >> b) & 1) AS ones, count(*) AS n FROM (
                  SELECT id, ('0x' || substr(sha1(lower(t)), 1, 16))::UBIGINT::HUGEINT AS v FROM (
                    SELECT id, unnest(regexp_extract_all(title || ' ' || clean_text, '[A-Za-z0-9А-Яа-яЁё]+')) AS t FROM items) WHERE length(t) >= 3)
                CROSS JOIN (SELECT unnest(range(64)) AS b) GROUP BY id, b)
          GROUP BY id) f ON f.id = i.id"""),
    # pairs of an earlier and a later item that conflict
    "near_conflicts": (["simhashes"], """
        SELECT e.id AS e, l.id AS l FROM simhashes e JOIN simhashes l ON e.arrival_idx < l.arrival_idx AND bit_count(xor(e.simhash, l.simhash)) <= 6"""),
    "title_conflicts": (["title_sets"], rf"""
        WITH u AS (SELECT id, arrival_idx, published_at, norm, list_sort(words) AS words, len(words) AS n, string_split(norm, ' ') AS toks
            FROM title_sets WHERE len(words) >= 3),
        -- similar sets share one of the first words in any fixed order, and a part's inner words are words of the whole
        heads AS (SELECT id, n, unnest(words[1:n - CAST(ceil(0.85 * n - 1e-9) AS INTEGER) + 1]) AS w FROM u),
        alike AS (SELECT DISTINCT a.id AS x, b.id AS y FROM heads a JOIN heads b ON a.w = b.w AND a.id <> b.id AND a.n >= 0.85 * b.n AND b.n >= 0.85 * a.n),
        longest AS (SELECT id, list_reverse_sort(list_transform(toks[2:len(toks) - 1], lambda t: {{'n': length(t), 't': t}}))[1].t AS w FROM u),
        inner_words AS (SELECT DISTINCT id, unnest(toks) AS w FROM u),
        parts AS (SELECT a.id AS x, b.id AS y FROM longest a JOIN inner_words b ON a.w = b.w AND a.id <> b.id),
        pairs AS (SELECT x, y FROM alike UNION SELECT x, y FROM parts UNION SELECT y, x FROM parts UNION
            SELECT a.id, b.id FROM u a JOIN u b ON a.norm = b.norm AND a.id <> b.id)
        SELECT e.id AS e, l.id AS l FROM pairs JOIN u e ON e.id = x JOIN u l ON l.id = y AND e.arrival_idx < l.arrival_idx
          AND e.published_at > {AS_OF} - INTERVAL 24 HOUR
        WHERE e.norm = l.norm OR (length(l.norm) > 40 AND (contains(e.norm, l.norm) OR contains(l.norm, e.norm)))
          OR (least(e.n, l.n) >= 0.85 * greatest(e.n, l.n)
            AND len(list_intersect(e.words, l.words))::DOUBLE / len(list_distinct(list_concat(e.words, l.words))) >= 0.85)"""),
}
