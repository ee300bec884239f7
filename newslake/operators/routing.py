"""Who gets what: source settings, delivery rules, selections, invites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions.base import blank_to_null, text
from newslake.operators import ordered
from newslake.operators.gates import category_matches, in_env, with_freshness


def disabled_pairs(settings: DataFrame, env: str = "prod") -> DataFrame:
    """(user, source id) pairs a user switched off."""
    return settings.filter(in_env(F.col("env"), env) & ~F.col("enabled")).select("user_id", "source_id").distinct()


def visible(pairs: DataFrame, settings: DataFrame, sources: DataFrame, env: str = "prod") -> DataFrame:
    """(user, item) candidates whose source the user has not switched off; unknown sources pass."""
    off = disabled_pairs(settings, env).join(
        sources.select(F.col("id").alias("source_id"), F.col("code").alias("source")), "source_id"
    ).select("user_id", "source")
    return pairs.join(off, ["user_id", "source"], "left_anti").select(*pairs.columns)


def _source_ids(sources: DataFrame) -> Column:
    """All source ids as one array; the catalogue is a configuration list."""
    return sources.agg(F.sort_array(F.collect_set("id"))).scalar()


def enabled_sources(users: DataFrame, settings: DataFrame, sources: DataFrame, env: str = "prod") -> DataFrame:
    """Enabled source ids per user: all of the catalogue minus the user's own off-list."""
    off = disabled_pairs(settings, env).groupBy("user_id").agg(F.collect_set("source_id").alias("_off"))
    ids = F.array_except(_source_ids(sources), F.coalesce("_off", F.array().cast("array<bigint>")))
    return users.select("user_id").distinct().join(off, "user_id", "left").select("user_id", F.sort_array(ids).alias("source_ids"))


def enabled_map(users: DataFrame, settings: DataFrame, sources: DataFrame, env: str = "prod") -> DataFrame:
    """One row per user and source with the on/off state, on by default."""
    own = settings.filter(in_env(F.col("env"), env)).select("user_id", "source_id", "enabled")
    grid = users.select("user_id").distinct().select("user_id", F.explode(_source_ids(sources)).alias("source_id"))
    return grid.join(own, ["user_id", "source_id"], "left").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def current_toggles(toggles: DataFrame) -> DataFrame:
    """State after a log of flips, starting from on."""
    return toggles.groupBy("user_id", "source_id").agg((F.count("*") % 2 == 0).alias("enabled"))


def pending(items: DataFrame, users: DataFrame, as_of: Column, per_user: int = 50) -> DataFrame:
    """Backlog per user: the next items after the last delivered one, then freshness and category rules.

    The page of ``per_user`` items is taken before the rules.  Users and items
    meet on the items' dense rank, never as a cross product.
    """
    marks = users.select("user_id", "category_filter", F.coalesce("last_delivered_news_id", F.lit(0)).alias("_last"))
    by_rank, before = ordered.rank_by_id(items, marks, "id", "_last")
    window = marks.join(before, "_last").select(
        "user_id", "category_filter",
        F.explode(F.sequence(F.col("items_before") + 1, F.col("items_before") + per_user)).alias("id_rank"),
    )
    slim = items.select("id", "category", "published_at", "fetched_at", "domain", "source")
    page = window.join(by_rank, "id_rank").join(slim, "id")
    page = with_freshness(page, as_of).filter(F.col("reason").isNull())
    return page.filter(category_matches(F.col("category_filter"), F.col("category"))).select("user_id", "id", "source", "category")


def delivery_decisions(pairs: DataFrame, preferences: DataFrame, settings: DataFrame, sources: DataFrame,
                       log: DataFrame, env: str = "prod") -> DataFrame:
    """Skip reason of each (user, item) candidate, null when it is delivered.

    Order of the checks: category, pause, watermark, source, delivery log.
    """
    prefs = preferences.filter(in_env(F.col("env"), env)).select(
        "user_id", "category_filter", "is_paused", F.coalesce("last_delivered_news_id", F.lit(0)).alias("_last"))
    off = disabled_pairs(settings, env).join(
        sources.select(F.col("id").alias("source_id"), F.col("code").alias("source")), "source_id"
    ).select("user_id", "source", F.lit(True).alias("_off"))
    sent = log.select("user_id", "news_id", F.lit(True).alias("_sent")).distinct()
    rows = pairs.join(prefs, "user_id", "left").join(off, ["user_id", "source"], "left").join(sent, ["user_id", "news_id"], "left")
    return rows.withColumn(
        "skip_reason",
        F.when(~category_matches(F.col("category_filter"), F.col("category")), "CATEGORY")
        .when(F.coalesce("is_paused", F.lit(False)), "PAUSED")
        .when((F.coalesce("_last", F.lit(0)) > 0) & (F.col("news_id") <= F.col("_last")), "DUPLICATE")
        .when(F.col("_off").isNotNull(), "SOURCE_DISABLED")
        .when(F.col("_sent").isNotNull(), "DUPLICATE"),
    ).select(*pairs.columns, "skip_reason")


def new_deliveries(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidate deliveries that are not logged yet, each once."""
    once = ordered.first_row(candidates, ["user_id", "news_id"], ["delivered_at"])
    return once.join(log.select("user_id", "news_id"), ["user_id", "news_id"], "left_anti")


def undo_deliveries(log: DataFrame, failures: DataFrame) -> DataFrame:
    return log.join(failures.select("user_id", "news_id"), ["user_id", "news_id"], "left_anti")


def selections_with_items(selections: DataFrame, items: DataFrame, env: str = "prod") -> DataFrame:
    """Selected items, newest selection first; selections of missing items are skipped."""
    own = selections.filter(in_env(F.col("env"), env)).select("user_id", F.col("news_id").alias("id"), "selected_at")
    return own.join(items, "id")


def with_selected_flag(pairs: DataFrame, selections: DataFrame, env: str = "prod") -> DataFrame:
    own = selections.filter(in_env(F.col("env"), env)).select("user_id", "news_id", F.lit(True).alias("_s")).distinct()
    return pairs.join(own, ["user_id", "news_id"], "left").withColumn("is_selected", F.col("_s").isNotNull()).drop("_s")


def current_selections(log: DataFrame) -> DataFrame:
    """Selection state after add / remove / clear events."""
    stamp = F.struct("ts", "id")
    clears = log.filter("action = 'clear'").groupBy("user_id").agg(F.max(stamp).alias("_cleared"))
    last = log.filter("action <> 'clear'").groupBy("user_id", "news_id").agg(
        F.max(stamp).alias("_at"), F.max_by("action", stamp).alias("action"))
    return (
        last.filter("action = 'add'").join(clears, "user_id", "left")
        .filter(F.col("_cleared").isNull() | (F.col("_at") > F.col("_cleared"))).select("user_id", "news_id")
    )


def current_preferences(log: DataFrame) -> DataFrame:
    """Each preference keeps the value of the latest row that sets it."""
    stamp = F.struct("ts", "id")
    latest = lambda value, sets: F.max_by(value, F.when(F.col(sets), stamp))
    return log.groupBy("user_id").agg(
        latest("category_filter", "sets_category").alias("category_filter"),
        F.coalesce(latest("translate_enabled", "sets_translation"), F.lit(False)).alias("translate_enabled"),
        F.coalesce(latest("translate_lang", "sets_translation"), F.lit("ru")).alias("translate_lang"),
    )


def pause_states(log: DataFrame) -> DataFrame:
    """Pause version (number of toggles) and latest state per user."""
    return log.filter("sets_pause").groupBy("user_id").agg(
        F.count("*").alias("pause_version"), F.max_by("is_paused", F.struct("ts", "id")).alias("is_paused"))


def delivery_watermarks(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id").agg(
        F.max_by("news_id", F.struct("delivered_at", "news_id")).alias("last_delivered_news_id"))


def redeem_invites(requests: DataFrame, invites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First request per unused code wins: (used invites, approved users)."""
    open_codes = invites.filter(text("used_by") == "").select("code", "created_by")
    first = ordered.first_row(requests.select("code", "user_id", "ts", "id"), ["code"], ["ts", "id"])
    used = first.join(open_codes, "code").select("code", F.col("user_id").alias("used_by"), "created_by", "ts", "id")
    approved = used.groupBy(F.col("used_by").alias("user_id")).agg(
        F.max_by("created_by", F.struct("ts", "id")).alias("invited_by"))
    return used.select("code", "used_by", "created_by"), approved


def recipients(approved: DataFrame, admins: DataFrame) -> DataFrame:
    """Approved users, or the administrators when there are none."""
    users = approved.select(F.col("user_id").try_cast("bigint").alias("user_id")).filter(F.col("user_id").isNotNull()).distinct()
    nobody = users.agg(F.count("*")).scalar() == 0
    backup = admins.select(F.col("user_id").cast("bigint").alias("user_id")).distinct().filter(nobody)
    return users.unionByName(backup)


def translation_requests(pairs: DataFrame, preferences: DataFrame, cache: DataFrame, env: str = "prod") -> DataFrame:
    """(item, language) translations that users want, that are English, and that are not cached.

    ``pairs`` brings user_id, news_id, language, checksum and the text's length as ``n_chars``.
    """
    wanting = preferences.filter(in_env(F.col("env"), env) & F.col("translate_enabled")).select(
        "user_id", F.coalesce(blank_to_null("translate_lang"), F.lit("ru")).alias("target_lang"))
    rows = pairs.filter((F.col("language") == "en") & (F.col("n_chars") > 0)).join(wanting, "user_id")
    need = rows.select("news_id", "checksum", "target_lang").distinct()
    return need.join(cache.select("news_id", "checksum", "target_lang"), ["news_id", "checksum", "target_lang"], "left_anti")


def source_pages(sources: DataFrame, size: int = 8) -> DataFrame:
    """Sources by title, in pages: page number from 0 and number of pages."""
    numbered = ordered.global_row_number(sources, ["title", "id"], "n")
    pages = F.ceil(sources.agg(F.count("*")).scalar() / F.lit(size))
    return numbered.withColumn("page", F.floor((F.col("n") - 1) / size)).withColumn("pages", pages)
