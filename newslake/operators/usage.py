"""Token usage, budgets, caches, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.functions import lexicon as lx
from newslake.operators import ordered
from newslake.functions.base import strings

OPERATIONS = ["summarize", "category", "text_clean"]


def usage_totals(log: DataFrame) -> DataFrame:
    """Totals overall and for the three tracked operations; other operations count only in the totals."""
    tokens = F.col("tokens_in") + F.col("tokens_out")
    aggs = [F.count("*").alias("total_requests"), F.coalesce(F.sum(tokens), F.lit(0)).alias("total_tokens"),
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd")]
    for name in OPERATIONS:
        mine = F.col("operation") == name
        aggs += [F.count_if(mine).alias(f"{name}_requests"),
                 F.coalesce(F.sum(F.when(mine, tokens)), F.lit(0)).alias(f"{name}_tokens")]
    return log.agg(*aggs)


def daily_usage(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost_usd"),
        F.count("*").alias("calls"), F.count_if("cache_hit").alias("cache_hits"))


def totals_since_baseline(log: DataFrame, baselines: DataFrame) -> DataFrame:
    """Latest baseline replaces the totals; facts after it add on."""
    base = baselines.agg(F.max_by(F.struct("ts", "total_requests", "total_tokens", "total_cost_usd"), "ts").alias("b"))
    cut = base.select("b.ts").scalar()
    later = log.filter(cut.isNull() | (F.col("ts") > cut)).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0)).alias("t"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("c"))
    start = lambda name, zero: F.coalesce(base.select(f"b.{name}").scalar(), F.lit(zero))
    return later.select(
        (start("total_requests", 0) + F.col("n")).alias("total_requests"),
        (start("total_tokens", 0) + F.col("t")).alias("total_tokens"),
        (start("total_cost_usd", 0.0) + F.col("c")).alias("total_cost_usd"))


def budget_state(daily: DataFrame, limit_usd: float, reserve_usd: float, limit_tokens: int = 0,
                 estimate: Column | int = 0) -> DataFrame:
    """OK or DEGRADED per day, with the tasks that a degraded day refuses."""
    over = F.lit(False)
    if limit_usd > 0:
        over = over | (F.col("cost_usd") >= max(0.0, limit_usd - reserve_usd))
    if limit_tokens > 0:
        extra = F.greatest(F.lit(0), estimate if isinstance(estimate, Column) else F.lit(estimate))
        over = over | (F.col("tokens_in") + F.col("tokens_out") + extra >= limit_tokens)
    off = F.when(over, strings(sorted(lx.DEGRADE_ORDER))).otherwise(F.array().cast("array<string>"))
    return daily.withColumn("budget_state", F.when(over, "DEGRADED").otherwise("OK")).withColumn("degraded_features", off)


def task_allowed(task: Column, state: Column) -> Column:
    """Only the tracked tasks are refused on a degraded day."""
    return (state == "OK") | ~task.isin(lx.DEGRADE_ORDER)


def spend_mode(daily: DataFrame, limit_usd: float) -> DataFrame:
    """block ≥ 100 %, warning ≥ 90 %, economy ≥ 80 % of the daily limit."""
    c = F.col("cost_usd")
    if limit_usd <= 0:
        return daily.withColumn("mode", F.lit("normal"))
    return daily.withColumn(
        "mode", F.when(c >= limit_usd, "block").when(c >= limit_usd * 0.9, "warning")
        .when(c >= limit_usd * 0.8, "economy").otherwise("normal"))


def split_cost(total_tokens: Column) -> Column:
    """Cost of a token total at a 60/40 split of input and output."""
    return (F.floor(total_tokens * 0.6) / 1_000_000.0 * 0.14) + (F.floor(total_tokens * 0.4) / 1_000_000.0 * 0.28)


def hit_rate(hits: Column, calls: Column) -> Column:
    return F.when(calls > 0, hits / calls * 100.0).otherwise(F.lit(0.0))


def degraded_features(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


# ------------------------------------------------------------------- caches
def cache_stats(cache: DataFrame, as_of: Column) -> DataFrame:
    live = F.col("expires_at") > as_of
    return cache.agg(F.count("*").alias("total"), F.count_if(live).alias("active"), F.count_if(~live).alias("expired"))


def purge_expired(cache: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, number of deleted rows)."""
    gone = F.col("expires_at") < as_of
    return cache.filter(~gone), cache.agg(F.count_if(gone).alias("deleted"))


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Requests with the live cached response, if any, and a hit flag."""
    live = cache.filter(F.col("expires_at") > as_of).select("cache_key", "response_json", "input_tokens", "output_tokens")
    return requests.join(live, "cache_key", "left").withColumn("cache_hit", F.col("response_json").isNotNull())


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Table after an upsert: newest row per key, new rows win ties."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return ordered.latest_row(both, keys, [*version, "_new"]).drop("_new")


def with_expiry(rows: DataFrame, hours: int = 72) -> DataFrame:
    return rows.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(hours=F.lit(hours)))


def cached_translations(requests: DataFrame, cache: DataFrame) -> DataFrame:
    keys = ["news_id", "checksum", "target_lang"]
    return requests.join(cache.select(*keys, "translated_text"), keys, "left")


def reusable_summaries(items: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Summaries younger than the limit."""
    return items.filter(F.col("ai_summary").isNotNull() & (F.col("ai_summary_created_at") > as_of - F.make_dt_interval(hours=F.lit(hours))))


# ------------------------------------------------------------------- levels
def _level(value: Column) -> Column:
    number = F.trim(value).try_cast("int")
    return F.when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(lx.MAX_LEVEL), number)))


def _setting(settings: DataFrame, key: str, name: str) -> DataFrame:
    return settings.filter(F.col("key") == key).select(F.col("scope").alias("user_id"), F.col("value").alias(name))


def effective_levels(users: DataFrame, settings: DataFrame, module: str, default: int = lx.DEFAULT_LEVEL) -> DataFrame:
    """User override, else the global level, else the default; 0 to 5."""
    key = f"ai_{module}_level"
    own = _setting(settings, key, "_own")
    overall = settings.filter((F.col("key") == key) & (F.col("scope") == "global")).agg(F.max(_level(F.col("value")))).scalar()
    return users.select("user_id").distinct().join(own, "user_id", "left").select(
        "user_id", F.coalesce(_level(F.col("_own")), overall, F.lit(default)).cast("int").alias("level"))


def migrated_levels(users: DataFrame, settings: DataFrame, module: str, default: int = lx.DEFAULT_LEVEL) -> DataFrame:
    """A user's own level; an old on/off flag maps to 0 or the default."""
    rows = users.select("user_id").distinct().join(_setting(settings, f"ai_{module}_level", "_l"), "user_id", "left") \
        .join(_setting(settings, f"ai_{module}_enabled", "_e"), "user_id", "left")
    low = F.lower("_e")
    on = F.when(F.col("_e").rlike(r"^\d+$"), F.col("_e").try_cast("int") != 0).otherwise(low.isin("true", "1", "yes"))
    return rows.select("user_id", F.when(F.col("_l").isNotNull(), F.coalesce(_level(F.col("_l")), F.lit(default)))
                       .when(F.col("_e").isNotNull(), F.when(on, F.lit(default)).otherwise(F.lit(0)))
                       .otherwise(F.lit(default)).alias("level"))


def level_profiles(spark: SparkSession) -> DataFrame:
    """Fifteen rows: module, level and its limits."""
    rows = [(m, i + 1, t, temp, p) for m, prof in lx.LEVEL_PROFILES.items() for i, (t, temp, p) in enumerate(prof)]
    return spark.createDataFrame(rows, "module string, level int, max_tokens int, temperature double, top_p double")


def with_profile(rows: DataFrame, module: Column) -> DataFrame:
    """Attach the profile of a level; level 0 is disabled, others are held within 1 to 5."""
    table = F.broadcast(level_profiles(rows.sparkSession))  # 15 rows by construction
    held = F.when(F.col("level") > 0, F.least(F.lit(5), F.col("level")))
    return (
        rows.withColumn("module", module).withColumn("_lv", held)
        .join(table.withColumnRenamed("level", "_lv"), ["module", "_lv"], "left")
        .withColumn("disabled", F.col("level") <= 0).drop("_lv")
    )


