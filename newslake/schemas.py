"""Schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



ITEM_DDL = """
    id long, arrival_idx long, url string, title string, source string, category string, lead_text string,
    raw_text string, clean_text string, checksum string, language string, domain string,
    extraction_method string, published_at timestamp, published_date string, published_time string,
    published_confidence string, published_source string, fetched_at timestamp, first_seen_at timestamp,
    url_hash string, url_normalized string, guid string, simhash long, quality_score double,
    hashtags_ru array<string>, hashtags_en array<string>, message_id long, ai_summary string,
    ai_summary_created_at timestamp
"""
DDL = {
    "items": ITEM_DDL,
    "feed_entries": "feed_url string, pos long, title string, link string, guid string, summary string, "
                    "published string, updated string",
    "pages": "page_id long, url string, html string",
    "source_events": "id long, source string, event_type string, error_code string, created_at timestamp",
    "fetch_log": "id long, url string, source string, kind string, status int, error string, ts timestamp",
    "sources": "id long, code string, title string, enabled_global boolean",
    "source_toggles": "id long, user_id string, source_id long, ts timestamp",
    "user_source_settings": "user_id string, source_id long, enabled boolean, env string",
    "user_preferences": "user_id string, env string, is_paused boolean, last_delivered_news_id long, "
                        "pause_version int, translate_enabled boolean, translate_lang string, category_filter string",
    "delivery_log": "user_id string, news_id long, delivered_at timestamp",
    "selections": "user_id string, news_id long, env string, selected_at timestamp",
    "usage_log": "ts timestamp, operation string, tokens_in long, tokens_out long, cost_usd double, cache_hit boolean",
    "response_cache": "cache_key string, task_type string, response_json string, input_tokens long, "
                      "output_tokens long, created_at timestamp, expires_at timestamp",
    "invites": "code string, created_by string, used_by string, created_at timestamp",
    "invite_requests": "id long, code string, user_id string, ts timestamp",
    "settings": "scope string, key string, value string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def conform(df: DataFrame, name: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Additive schema evolution: missing columns appear with their default (else null), types are aligned.

    Extra columns are kept at the end, so an older table and a newer one can be
    unioned by name.
    """
    defaults = defaults or {}
    have = set(df.columns)
    out = []
    for f in schema(name).fields:
        default = defaults.get(f.name)
        value = F.col(f.name) if f.name in have else F.lit(None)
        value = F.coalesce(value, default) if default is not None else value
        out.append(value.cast(f.dataType).alias(f.name))
    extra = [F.col(c) for c in df.columns if c not in schema(name).names]
    return df.select(*out, *extra)
