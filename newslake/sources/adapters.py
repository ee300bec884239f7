"""Plain projections of the landed tables onto the canonical tables.

Every adapter is a projection (or one aggregate) of a Parquet table, so filters
and column pruning reach the scan.  ``Tables`` builds each of them on demand.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.session import spread

AS_OF = "2024-01-31 00:00:00"

# Read with a fixed schema: event times as UTC instants, so that time ranges reach the scan without a cast.
SCHEMAS = {"events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string"}


def as_of(value: str = AS_OF) -> Column:
    return F.lit(value).cast("timestamp")


def _choose(n: Column, *values: str | None) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(n == i, F.lit(v)) if out is None else out.when(n == i, F.lit(v))
    return out


def _ago(base: str, hours: Column) -> Column:
    return F.lit(base).cast("timestamp") - F.make_dt_interval(hours=hours.cast("int"))


def _after(base: str, hours: Column) -> Column:
    return F.lit(base).cast("timestamp") + F.make_dt_interval(hours=hours.cast("int"))


class Tables:
    """Canonical tables over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        return reader.parquet(f"{self.path}/{name}.parquet")

    # ------------------------------------------------------------- content
    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents")

    @cached_property
    def wide_documents(self) -> DataFrame:
        return spread(self.documents, "doc_id")

    @cached_property
    def pages(self) -> DataFrame:
        return self.raw("pages")

    @cached_property
    def wide_pages(self) -> DataFrame:
        return spread(self.pages, "page_id")

    def _items(self, docs: DataFrame) -> DataFrame:
        d = F.col("doc_id")
        return (
            docs.select(
                (d + 1).alias("id"), d.alias("arrival_idx"),
                F.concat(F.lit("https://"), "source", F.lit(".example.com/item/"), d.cast("string")).alias("url"),
                F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                "source",
                _choose(d % 4, "world", "russia", "moscow", "moscow_region").alias("category"),
                F.col("text").alias("clean_text"),
                _ago("2024-01-30 23:59:00", d % 72).alias("published_at"),
                F.col("lang").alias("doc_lang"),
            )
            .withColumn("guid", F.col("url"))
            .withColumn("fetched_at", F.col("published_at") + F.expr("interval 5 minutes"))
        )

    @cached_property
    def items(self) -> DataFrame:
        return self._items(self.documents)

    @cached_property
    def wide_items(self) -> DataFrame:
        """Items spread over the cores, for per-row text work."""
        return self._items(self.wide_documents)

    @cached_property
    def feed_entries(self) -> DataFrame:
        """Feed entries that point at the items; every third round of a feed repeats an older link."""
        d = F.col("doc_id")
        linked = F.when((F.floor(d / 20) % 3 == 2), d - 20).otherwise(d)
        link = F.concat(
            F.lit("HTTPS://"), F.upper("source"), F.lit(".Example.com:443/item/"), linked.cast("string"),
            F.when(d % 3 == 1, "/?utm_source=rss&b=2&a=1#frag").otherwise("/?utm_source=rss#frag"),
        )
        at = _ago("2024-01-30 23:59:00", d % 72)
        return self.documents.select(
            d.alias("entry_id"), "source",
            F.concat(F.lit("https://"), "source", F.lit(".example.com/rss")).alias("feed_url"),
            F.floor(d / 20).alias("pos"),
            F.when(d % 50 != 7, F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
            F.when(d % 37 == 5, F.lit("")).otherwise(link).alias("link"),
            F.when(d % 3 == 0, F.concat(F.lit("https://"), "source", F.lit(".example.com/item/"), linked.cast("string")))
            .when(d % 3 == 2, link).alias("guid"),
            F.col("text").alias("summary"),
            F.when(d % 4 == 0, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss +0300"))
            .when(d % 4 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(d % 4 == 3, F.lit("some day soon")).alias("published"),
            F.when(d % 3 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("updated"),
        )

    @cached_property
    def feed_cache(self) -> DataFrame:
        """Cached feeds: one JSON array of two entries per address."""
        d = F.col("doc_id")
        title = F.split_part("text", F.lit("\n"), F.lit(1))
        entry = lambda t, k: F.struct(t.alias("title"), F.concat(F.lit("u"), d.cast("string"), F.lit(k)).alias("url"))
        return self.documents.select(
            F.concat(F.lit("https://"), "source", F.lit(".example.com/feed/"), d.cast("string")).alias("url"),
            F.to_json(F.array(entry(title, "a"), entry(F.lit("second"), "b"))).alias("items"),
            _ago("2024-01-31 00:00:00", d % 48).alias("cached_at"),
        )

    @cached_property
    def sources(self) -> DataFrame:
        number = F.regexp_extract("source", r"(\d+)$", 1).cast("long")
        return self.documents.select("source").distinct().select(
            (number + 1).alias("id"), F.col("source").alias("code"),
            F.concat(F.lit("Source "), F.upper("source")).alias("title"), F.lit(True).alias("enabled_global"),
        )

    # -------------------------------------------------------------- events
    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def source_events(self) -> DataFrame:
        kind = F.col("event_type")
        k = F.get_json_object("props", "$.k")
        return self.events.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"),
            F.when(kind.isin("click", "purchase"), "success").when(kind == "error", "error")
            .when(kind == "signup", "drop_old").otherwise("drop_date").alias("event_type"),
            F.when(kind.isin("error", "view"), F.concat(F.lit("E"), k)).alias("error_code"),
            F.when(kind == "error", F.concat(F.lit("fetch failed with code "), k)).alias("error_message"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def fetch_log(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        failed = F.col("event_type") == "error"
        src = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))
        return self.events.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("https://"), src, F.lit(".example.com/rss")).alias("url"), src.alias("source"),
            F.when(F.col("user_id") % 2 == 0, "rss").otherwise("html").alias("kind"),
            F.when(failed & (k % 6 < 4), _choose(k % 6, "403", "404", "429", "503").cast("int"))
            .when(~failed, F.lit(200)).alias("status"),
            F.when(failed & (k % 6 == 4), F.when(k % 4 == 0, "Read Timeout").otherwise("cannot parse the document"))
            .when(failed & (k % 6 == 5), F.when(k % 4 == 1, "DNS lookup failed").otherwise("boom")).alias("error"),
            failed.alias("failed"),
            F.col("ts"),
        )

    @cached_property
    def source_toggles(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"),
            (F.col("event_id") % 23 + 1).alias("source_id"), "ts",
        )

    @cached_property
    def user_source_settings(self) -> DataFrame:
        return self.source_toggles.groupBy("user_id", "source_id").agg(
            (F.count("*") % 2 == 0).alias("enabled"),
            F.when(F.max("id") % 11 == 0, F.lit(None)).when(F.max("id") % 11 == 1, "sandbox").otherwise("prod").alias("env"),
        )

    def _news_id(self) -> Column:
        total = self.documents.agg(F.count("*")).scalar()
        return F.col("event_id") % (total + 50) + 1

    @cached_property
    def delivery_log(self) -> DataFrame:
        return (
            self.events.filter("event_type = 'purchase'")
            .groupBy(F.col("user_id").cast("string").alias("user_id"), self._news_id().alias("news_id"))
            .agg(F.min("ts").alias("delivered_at"))
        )

    @cached_property
    def selections(self) -> DataFrame:
        return (
            self.events.filter("event_type = 'click'")
            .groupBy(F.col("user_id").cast("string").alias("user_id"), self._news_id().alias("news_id"))
            .agg(F.min("ts").alias("selected_at"))
            .withColumn("env", F.when(F.col("news_id") % 13 == 0, F.lit(None)).when(F.col("news_id") % 13 == 1, "sandbox").otherwise("prod"))
        )

    @cached_property
    def selection_log(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.filter(kind.isin("click", "view", "signup")).select(
            F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"),
            F.when(kind != "signup", F.col("event_id") % 40 + 1).alias("news_id"),
            F.when(kind == "click", "add").when(kind == "view", "remove").otherwise("clear").alias("action"), "ts",
        )

    @cached_property
    def preference_log(self) -> DataFrame:
        """Partial updates: each row sets some columns and leaves the others unset."""
        kind = F.col("event_type")
        return self.events.select(
            F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), "ts",
            (kind == "click").alias("sets_category"),
            F.when(kind == "click", _choose(F.col("event_id") % 3, "world", "moscow", None)).alias("category_filter"),
            (kind == "view").alias("sets_translation"),
            F.when(kind == "view", F.col("event_id") % 2 == 0).alias("translate_enabled"),
            F.when(kind == "view", _choose(F.col("event_id") % 2, "ru", "en")).alias("translate_lang"),
            (kind == "error").alias("sets_pause"),
            F.when(kind == "error", F.col("event_id") % 2 == 0).alias("is_paused"),
        )

    @cached_property
    def user_requests(self) -> DataFrame:
        """Summary requests of users: dense bursts, so that a limit per minute bites."""
        return self.events.select(
            F.col("event_id").alias("id"), (F.col("user_id") % 5).cast("string").alias("user_id"),
            F.timestamp_seconds(F.lit(1704067200) + F.floor(F.unix_micros("ts") / F.lit(40_000_000)) % F.lit(200_000)
                                ).alias("ts"),
        )

    @cached_property
    def log_lines(self) -> DataFrame:
        kind = F.col("event_type")
        level = F.when(kind == "error", "ERROR").when(kind == "view", "WARNING").otherwise("INFO")
        return self.events.select(
            F.concat(F.lit("worker-"), (F.col("user_id") % 4).cast("string"), F.lit(".log")).alias("file"),
            F.col("event_id").alias("line_no"),
            F.concat_ws(" ", F.lit("at"), level, F.lit("fetch of"), F.col("user_id").cast("string"),
                        F.when(kind == "click", "NO_ERRORS").otherwise("done")).alias("line"),
        )

    # --------------------------------------------------------------- users
    @cached_property
    def user_preferences(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.cast("string").alias("user_id"),
            F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, "sandbox").otherwise("prod").alias("env"),
            (k % 7 == 0).alias("is_paused"), (k % 100).alias("last_delivered_news_id"),
            (k % 3).cast("int").alias("pause_version"),
            (k % 3 == 0).alias("translate_enabled"), F.when(k % 2 == 0, "ru").alias("translate_lang"),
            _choose(k % 5, None, "world", "russia", "moscow", "moscow_region").alias("category_filter"),
        )

    @cached_property
    def settings(self) -> DataFrame:
        """Level settings: user rows of several kinds (good, out of range, broken, legacy)."""
        k = F.col("c_custkey")
        user = k.cast("string")
        cust = self.raw("customer")
        levels = cust.filter(k % 4 == 0).select(
            user.alias("scope"), F.lit("ai_summary_level").alias("key"),
            _choose(k % 16 / 4, "1", "9", "bad", "-2").alias("value"))
        legacy = cust.filter(k % 4 == 1).select(
            user.alias("scope"), F.lit("ai_summary_enabled").alias("key"),
            _choose((k % 16 - 1) / 4, "0", "1", "true", "off").alias("value"))
        glob = self.raw("region").filter("r_regionkey = 0").select(
            F.lit("global").alias("scope"), F.lit("ai_summary_level").alias("key"), F.lit("4").alias("value"))
        return levels.unionByName(legacy).unionByName(glob)

    @cached_property
    def invites(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            F.concat(F.lit("inv"), k.cast("string")).alias("code"), F.col("s_nationkey").cast("string").alias("created_by"),
            F.when(k % 4 == 0, "someone").alias("used_by"),
            _after("2024-01-01 00:00:00", k % 700).alias("created_at"),
        )

    @cached_property
    def invite_requests(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("id"), F.concat(F.lit("inv"), (k % 150).cast("string")).alias("code"),
            F.col("o_custkey").cast("string").alias("user_id"),
            (F.lit("2024-01-02 00:00:00").cast("timestamp") + F.make_dt_interval(secs=((k * 7919) % 100000).cast("decimal(18,6)"))).alias("ts"),
        )

    # --------------------------------------------------------------- usage
    @cached_property
    def usage_log(self) -> DataFrame:
        tokens = F.floor(F.length("text") / 4)
        t_in = F.when(F.col("role") != "assistant", tokens).otherwise(F.lit(0))
        t_out = F.when(F.col("role") == "assistant", tokens).otherwise(F.lit(0))
        return self.raw("conversations").select(
            _after("2024-01-01 00:00:00", F.col("conv_id")).alias("ts"),
            _choose(F.col("conv_id") % 4, "summarize", "category", "text_clean", "translate").alias("operation"),
            t_in.alias("tokens_in"), t_out.alias("tokens_out"),
            (t_in * F.lit(0.00000014) + t_out * F.lit(0.00000028)).alias("cost_usd"),
            (F.col("turn") % 5 == 0).alias("cache_hit"), "conv_id", "turn",
        )

    @cached_property
    def calls(self) -> DataFrame:
        """Task calls of ticks, in order, for the per-tick gate."""
        return self.raw("conversations").select(
            F.floor(F.col("conv_id") / 3).alias("tick_id"),
            (F.col("conv_id") * 100 + F.col("turn")).alias("call_no"),
            _choose((F.col("conv_id") + F.col("turn")) % 4, "summary", "cleanup", "hashtags_ai", "translate").alias("task"),
        )

    @cached_property
    def response_cache(self) -> DataFrame:
        k = F.col("item_id")
        return self.raw("benchmark").select(
            F.md5("text").alias("cache_key"), _choose(k % 3, "summarize", "category", "text_clean").alias("task_type"),
            F.to_json(F.struct(F.col("text").alias("summary"))).alias("response_json"),
            F.floor(F.length("text") / 4).alias("input_tokens"), (k % 7 + 50).alias("output_tokens"),
            _after("2024-01-27 04:00:00", k).alias("created_at"), _after("2024-01-30 04:00:00", k).alias("expires_at"),
        )

    @cached_property
    def translation_cache(self) -> DataFrame:
        lab = self.raw("labels")
        return self.documents.join(lab, "doc_id").select(
            (F.col("doc_id") + 1).alias("news_id"),
            F.when(F.col("toxic") == 1, "stale").otherwise(F.sha2("text", 256)).alias("checksum"),
            F.lit("ru").alias("target_lang"), F.concat(F.lit("translated "), F.col("doc_id").cast("string")).alias("translated_text"),
        )
