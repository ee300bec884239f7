"""Streaming queries, drained over the tables, and the ingestion tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions import fingerprint as fp
from newslake.plans import ingest
from newslake.plans.common import DEMO, feed_items, keep_first, printed
from newslake.plans.registry import REGISTRY as R
from newslake.plans.views import AS_OF
from newslake.sources.adapters import Tables, as_of
from newslake.streaming import jobs
from newslake.streaming.store import read_batches


#: A time after all rows of the tables.
CLOSED = "2100-01-01 00:00:00"


class StreamTables(Tables):
    """The canonical tables over streams of the same folder."""

    def raw(self, name: str) -> DataFrame:
        return jobs.read_table_stream(self.spark, self.path, name)


def _streams(t: Tables) -> StreamTables:
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return StreamTables(t.spark, t.path)


@R.add("ingest_tick")
def ingest_tick(t: Tables) -> DataFrame:
    """Publishable items of the last twelve hours against everything before them."""
    collected = t.wide_items.filter(F.col("published_at") > as_of() - F.make_dt_interval(hours=F.lit(12)))
    store = printed(t.wide_items.filter(F.col("published_at") <= as_of() - F.make_dt_interval(hours=F.lit(12)))).select(
        "id", "title", "guid", "url_hash", "checksum", "url_normalized", "simhash", "published_at")
    published, _ = ingest.tick(collected, store, as_of(), DEMO)
    return published.select("id", "url", "title", "category", "language", F.array_join("hashtags_ru", " ").alias("hashtags_ru"),
                            F.array_join("hashtags_en", " ").alias("hashtags_en"))


def _closing(s: StreamTables, **columns: Column) -> DataFrame:
    """A few rows dated after all others, so that the time of a drained stream passes its last rows."""
    return jobs.read_table_stream(s.spark, s.path, "region").select(*[c.alias(n) for n, c in columns.items()])


def _tick_items(s: StreamTables) -> DataFrame:
    return s._items(s.documents)


@R.add("t01_ingest_stream")
def t01(t: Tables) -> DataFrame:
    """The ingestion stream, drained: rows it published."""
    s = _streams(t)
    store, drops = jobs.work_dir(t.spark, "store"), jobs.work_dir(t.spark, "drops")
    handler = jobs.ingest_handler(t.spark, store, drops, lambda _: as_of(), limit=None)
    jobs.run_ticks(_tick_items(s), handler, jobs.work_dir(t.spark, "t01"), interval=None).awaitTermination()
    return read_batches(t.spark, store, "id long, url string, category string").select("id", "url", "category")


def _drops(t: Tables, shift_hours: int) -> DataFrame:
    s = _streams(t)
    now = as_of() - F.make_dt_interval(hours=F.lit(shift_hours))
    out = jobs.work_dir(t.spark, "rejects")

    def handle(batch: DataFrame, batch_id: int) -> None:
        _, events = ingest.split_fresh(batch.withColumn("domain", F.lit("feed.example")), now)
        events.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    jobs.run_ticks(_tick_items(s), handle, jobs.work_dir(t.spark, "rejects-state"), interval=None).awaitTermination()
    names = ["id", "source", "event_type", "error_code"]
    return read_batches(t.spark, out, "id long, source string, event_type string, error_code string").select(*names)


@R.add("t02_late_rows_logged", views="items", sql=f"""
    SELECT id, source, 'drop_old' AS event_type, NULL::VARCHAR AS error_code FROM items WHERE published_at < {AS_OF} - INTERVAL 36 HOUR""")
def t02(t: Tables) -> DataFrame:
    return _drops(t, 0)


@R.add("t03_early_rows_logged", views="items", sql=f"""
    SELECT id, source, CASE WHEN published_at > {AS_OF} - INTERVAL 30 HOUR + INTERVAL 5 MINUTE THEN 'drop_date' ELSE 'drop_old' END AS event_type,
           CASE WHEN published_at > {AS_OF} - INTERVAL 30 HOUR + INTERVAL 5 MINUTE THEN 'PARSE_DATE_FAILED' END AS error_code
    FROM items WHERE published_at > {AS_OF} - INTERVAL 30 HOUR + INTERVAL 5 MINUTE OR published_at < {AS_OF} - INTERVAL 66 HOUR""")
def t03(t: Tables) -> DataFrame:
    return _drops(t, 30)


@R.add("t04_distinct_content", views="items", sql="SELECT DISTINCT sha256(clean_text) AS checksum FROM items")
def t04(t: Tables) -> DataFrame:
    rows = _tick_items(_streams(t)).select("published_at", fp.checksum("clean_text").alias("checksum"))
    return jobs.drain(jobs.distinct_content(rows), "t04").select("checksum")


@R.add("t05_unseen_stream", views="feed_items", sql="""
    WITH a AS (SELECT * FROM feed_items QUALIFY url_hash = '' OR row_number() OVER (PARTITION BY url_hash ORDER BY arrival_idx) = 1)
    SELECT id, url FROM a QUALIFY coalesce(guid, '') = '' OR row_number() OVER (PARTITION BY guid ORDER BY arrival_idx) = 1""")
def t05(t: Tables) -> DataFrame:
    store = jobs.work_dir(t.spark, "seen")
    handler = jobs.unseen_handler(t.spark, store)
    jobs.run_ticks(feed_items(_streams(t)), handler, jobs.work_dir(t.spark, "t05"), interval=None).awaitTermination()
    return read_batches(t.spark, store, "id long, url string").select("id", "url")


@R.add("t06_near_duplicate_stream", views="items near_conflicts", sql=keep_first("near_conflicts"))
def t06(t: Tables) -> DataFrame:
    rows = _tick_items(_streams(t)).select("id", "arrival_idx", "published_at", fp.simhash("clean_text", "title").alias("simhash"))
    store = jobs.work_dir(t.spark, "near")
    jobs.run_ticks(rows, jobs.near_duplicate_handler(t.spark, store, as_of()), jobs.work_dir(t.spark, "t06"), interval=None).awaitTermination()
    return read_batches(t.spark, store, "id long").select("id")


@R.add("t07_sliding_counts", views="source_events", sql="""
    SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, source, count(*) FILTER (WHERE event_type = 'success') AS success_count,
           count(*) FILTER (WHERE event_type = 'error') AS error_count, count(*) FILTER (WHERE event_type = 'drop_old') AS drop_old_count,
           count(*) FILTER (WHERE event_type = 'drop_date') AS drop_date_count
    FROM (SELECT *, date_trunc('hour', created_at) - to_hours(CAST(h AS INTEGER)) AS start FROM source_events, (SELECT unnest(range(24)) AS h)) GROUP BY ALL""")
def t07(t: Tables) -> DataFrame:
    s = _streams(t)
    events = s.source_events.select("source", "event_type", "created_at")
    end = _closing(s, source=F.lit("closing"), event_type=F.lit(""), created_at=F.lit(CLOSED).cast("timestamp"))
    counts = jobs.sliding_event_counts(events.unionByName(end))
    out = jobs.drain(counts.select(F.col("window.start").alias("start"), *[c for c in counts.columns if c != "window"]), "t07")
    # closing rows go last: a filter on the stream would be pushed below the watermark that they carry on
    return out.where("NOT source <=> 'closing'").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "source", *[f"{k}_count" for k in jobs.EVENT_KINDS])


@R.add("t08_error_sessions", views="fetch_log", sql="""
    WITH f AS (SELECT *, lag(ts) OVER (PARTITION BY url ORDER BY ts, id) AS prev FROM fetch_log WHERE failed),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS seg FROM f)
    SELECT url, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS failures FROM g GROUP BY url, seg""")
def t08(t: Tables) -> DataFrame:
    sessions = jobs.error_sessions(_streams(t).fetch_log)
    rows = jobs.drain(sessions.select("url", F.col("session_window.start").alias("start"), "failures"), "t08", "complete")
    return rows.select("url", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "failures")


@R.add("t09_rate_limit_stream", views="rate_limited", sql="SELECT * FROM rate_limited")
def t09(t: Tables) -> DataFrame:
    s = _streams(t)
    end = _closing(s, id=F.lit(-1).cast("long"), user_id=F.lit("closing"), ts=F.lit(CLOSED).cast("timestamp"))
    verdicts = jobs.rate_limited_stream(s.user_requests.select("id", "user_id", "ts").unionByName(end))
    return jobs.drain(verdicts.where("NOT user_id <=> 'closing'"), "t09").select("user_id", "id", "accepted")


@R.add("t10_daily_usage", views="daily_usage", sql="SELECT date, tokens_in, tokens_out, calls, cache_hits FROM daily_usage")
def t10(t: Tables) -> DataFrame:
    days = jobs.daily_usage_windows(_streams(t).usage_log)
    rows = jobs.drain(days.select(F.col("window.start").alias("start"), "tokens_in", "tokens_out", "calls", "cache_hits"), "t10", "update")
    out = jobs.newest_update(rows, ["start"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("date"), "tokens_in", "tokens_out", "calls", "cache_hits")


@R.add("t11_exactly_once_delivery", sql="""
    SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, event_id % 500 + 1 AS news_id FROM events WHERE event_type = 'purchase'""")
def t11(t: Tables) -> DataFrame:
    log = jobs.work_dir(t.spark, "deliveries")
    stream = _streams(t).events.filter("event_type = 'purchase'").select(
        F.col("user_id").cast("string").alias("user_id"), (F.col("event_id") % 500 + 1).alias("news_id"), F.col("ts").alias("delivered_at"))
    batches = 0
    for run in ("t11-a", "t11-b"):  # the second run repeats every delivery under the numbers that follow
        query = jobs.run_ticks(stream, jobs.delivery_handler(t.spark, log, batches), jobs.work_dir(t.spark, run), interval=None)
        query.awaitTermination()
        batches = 1 + max((p["batchId"] for p in query.recentProgress), default=-1)
    return read_batches(t.spark, log, "user_id string, news_id long").select("user_id", "news_id")


@R.add("t12_cache_expiry", views="response_cache", sql=f"SELECT cache_key, task_type FROM response_cache WHERE expires_at >= {AS_OF}")
def t12(t: Tables) -> DataFrame:
    """Entries that no expiry event before the tick has ended.

    Time is carried by the entries; a second stream of the same table, dated at the tick under keys of its own, takes it there.
    """
    entries = _streams(t).response_cache
    ahead = entries.withColumns({"cache_key": F.concat(F.lit("ahead|"), "cache_key"), "created_at": F.greatest("created_at", as_of())})
    ended = jobs.drain(jobs.expired_entries(entries.unionByName(ahead)), "t12").where(F.col("expires_at") < as_of())
    return t.response_cache.join(ended.select("cache_key"), "cache_key", "left_anti").select("cache_key", "task_type")
