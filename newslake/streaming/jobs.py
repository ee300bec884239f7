"""Structured Streaming jobs: ingestion ticks, keyed state, windows, deliveries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from newslake.functions import urls
from newslake.operators import dedup, ordered, routing
from newslake.plans import ingest
from newslake.session import checkpoint_dir, cut
from newslake.streaming import store

TICK_INTERVAL = "300 seconds"


# ----------------------------------------------------------------- running
def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream of one Parquet table of a folder, a single file or a folder of files; the schema comes from the table's footer."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):  # a stream reads folders: this one, for the one file
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def work_dir(spark: SparkSession, label: str) -> str:
    """Fresh folder beside the checkpoints, shared by the cluster."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def run_ticks(stream: DataFrame, handle: Callable[[DataFrame, int], None], state_dir: str, interval: str | None = TICK_INTERVAL) -> StreamingQuery:
    """One micro-batch per interval, never overlapping; ``interval=None`` drains what is there and stops."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", state_dir)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its output rows.

    Update-mode output is kept with its batch number, so that a reader takes the newest row of a key.
    """
    spark = stream.sparkSession
    out = work_dir(spark, label)

    def save(batch: DataFrame, batch_id: int) -> None:
        writer = batch.withColumn("batch_id", F.lit(batch_id)).write
        writer.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", work_dir(spark, f"{label}-state"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return store.read_batches(spark, out, StructType([*stream.schema.fields, StructField("batch_id", IntegerType())]))


# --------------------------------------------------------------- ingestion
#: Days of rows that the duplicate rules of a tick look back to.
HORIZON = "INTERVAL 48 HOURS"
ITEM_KEYS = ["guid", "url_hash", "url_normalized"]


def _item_keys(rows: DataFrame, names: list[str]) -> DataFrame:
    return store.key_rows(rows, {name: F.col(name) for name in names})


def _addressed(items: DataFrame) -> DataFrame:
    normal = urls.normalize_url("url")
    return items.select("guid", normal.alias("url_normalized"), F.when(normal != "", F.sha2(normal, 256)).alias("url_hash"))


def ingest_handler(spark: SparkSession, store_path: str, drops_path: str, as_of: Callable[[DataFrame], Column],
                   limit: int | None = None) -> Callable[[DataFrame, int], None]:
    """Batch handler of the ingestion stream: freshness split, duplicate rules against the store, append.

    Late and too-early rows go to ``drops_path`` as events instead of vanishing behind a watermark, and each published row
    leaves a ``success`` event in ``store_path/_events``.  Guids and addresses are looked up in the index of all keys;
    checksums, fingerprints and titles in the days of the horizon.  A repeated batch rewrites its own files.
    """
    index = store.KeyIndex(spark, f"{store_path}/_keys")

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = as_of(batch)
        kept = store.DatedStore(spark, store_path, ingest.with_tags(ingest.enrich(batch)).schema)
        index.merge(batch_id)
        known = store.key_columns(index.seen(_item_keys(_addressed(batch), ITEM_KEYS), batch_id), ITEM_KEYS)
        recent = kept.since(now - F.expr(HORIZON), batch_id)
        rows, drops = ingest.tick(batch, recent.unionByName(known, allowMissingColumns=True), now, limit=limit)
        kept.write(rows, batch_id)
        drops.write.mode("overwrite").parquet(f"{drops_path}/batch={batch_id}")
        written = kept.of_batch(batch_id)
        ingest.success_events(written, now).write.mode("overwrite").parquet(f"{store_path}/_events/batch={batch_id}")
        index.add(_item_keys(written, ITEM_KEYS), batch_id)

    return handle


def distinct_content(stream: DataFrame, hours: int = 48) -> DataFrame:
    """First row per checksum within the horizon; state older than it is dropped."""
    return stream.withWatermark("published_at", f"{hours} hours").dropDuplicatesWithinWatermark(["checksum"])


def unseen_handler(spark: SparkSession, store_path: str) -> Callable[[DataFrame, int], None]:
    """Append rows whose guid and address are not in the store yet (unbounded horizon)."""
    index, names = store.KeyIndex(spark, f"{store_path}/_keys"), ["guid", "url_hash"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        index.merge(batch_id)
        known = store.key_columns(index.seen(_item_keys(batch, names), batch_id), names)
        rows = dedup.staged_first_wins(batch, {"k_hash": F.col("url_hash"), "k_guid": F.coalesce("guid", F.lit(""))})
        out = f"{store_path}/batch={batch_id}"
        dedup.unseen_keys(rows, known).write.mode("overwrite").parquet(out)
        index.add(_item_keys(spark.read.schema(batch.schema).parquet(out), names), batch_id)

    return handle


def near_duplicate_handler(spark: SparkSession, store_path: str, as_of: Column) -> Callable[[DataFrame, int], None]:
    """Append rows that are near no recent stored fingerprint nor an earlier row of the batch; reads the days of the horizon."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = store.DatedStore(spark, store_path, batch.schema)
        batch = cut(batch)  # read by several steps; the fingerprints are computed once
        recent = kept.since(as_of - F.expr(HORIZON), batch_id)
        far = dedup.not_near_stored(batch, dedup.recent_fingerprints(recent, as_of))
        slim = dedup.first_of_copies(far.select("id", "arrival_idx", "simhash"), ["simhash"], F.col("simhash").isNotNull())
        first = dedup.keep_first_by_prefixes(cut(slim), [dedup.fingerprint_family()])
        kept.write(batch.join(first, "id", "left_semi"), batch_id)

    return handle


def delivery_handler(spark: SparkSession, log_path: str, start: int = 0) -> Callable[[DataFrame, int], None]:
    """Append each (user, item) once, however often it arrives.

    A stream that goes on with the log of another one starts at the number of batches in it.
    """
    index = store.KeyIndex(spark, f"{log_path}/_keys")
    keys = lambda rows: store.key_rows(rows, {"delivery": F.concat(F.col("news_id").cast("string"), F.lit(":"), F.col("user_id"))})

    def handle(batch: DataFrame, batch_id: int) -> None:
        number = start + batch_id
        index.merge(number)
        news = F.substring_index("key", ":", 1)
        log = index.seen(keys(batch), number).select(
            news.cast("long").alias("news_id"), F.col("key").substr(F.length(news) + 2, F.length("key")).alias("user_id"))
        out = f"{log_path}/batch={number}"
        routing.new_deliveries(batch, log).write.mode("overwrite").parquet(out)
        index.add(keys(spark.read.schema(batch.schema).parquet(out)), number)

    return handle


# ----------------------------------------------------------------- windows
EVENT_KINDS = ["success", "error", "drop_old", "drop_date"]


def sliding_event_counts(events: DataFrame, size: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, source, counts) of every sliding window that has ended, once each.

    Events are counted per (slide, source) first; those counts, one row each, are what the overlapping windows add up.
    """
    timely = events.withWatermark("created_at", late)
    steps = timely.groupBy(F.window("created_at", slide).alias("step"), "source").agg(
        *[F.count_if(F.col("event_type") == k).alias(k) for k in EVENT_KINDS])
    return steps.groupBy(F.window("step", size, slide), "source").agg(*[F.sum(k).alias(f"{k}_count") for k in EVENT_KINDS])


def error_sessions(fetches: DataFrame, gap: str = "600 seconds", late: str = "1 hour") -> DataFrame:
    return fetches.filter("failed").withWatermark("ts", late).groupBy(F.session_window("ts", gap), "url").agg(F.count("*").alias("failures"))


def daily_usage_windows(log: DataFrame, late: str = "1 hour") -> DataFrame:
    return log.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("*").alias("calls"),
        F.count_if("cache_hit").alias("cache_hits"))


def newest_update(rows: DataFrame, keys: list[str]) -> DataFrame:
    return ordered.latest_row(rows, keys, ["batch_id"])


# -------------------------------------------------------------- rate limit
class RateLimiter(StatefulProcessor):
    """Judges requests in the order of their times: they wait until the watermark has passed them.

    ``waiting`` holds the requests ahead of the watermark and ``passed`` at most ``limit`` accepted times; a timer at the
    least waiting time wakes the user, a last one a span after the newest accepted time ends the state.
    """

    def __init__(self, limit: int = 3, seconds: int = 60):
        self.limit, self.span = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("micros", LongType()), StructField("id", LongType())]))
        self.passed = handle.getValueState("passed", StructType([StructField("times", ArrayType(LongType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        for chunk in rows:
            self.waiting.appendList(list(zip(chunk["micros"].tolist(), chunk["id"].tolist())))
            self._wake(int(chunk["micros"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in held if r[0] < reached]
        live = list(self.passed.get()[0]) if self.passed.exists() else []
        verdicts = []
        for now, _ in due:
            live = [t for t in live if now - t < self.span]
            verdicts.append(len(live) < self.limit)
            if verdicts[-1]:
                live.append(now)
        live = [t for t in live if reached - t < self.span]
        if due:
            rest = held[len(due):]
            self.waiting.put(rest) if rest else self.waiting.clear()
        self.passed.update((live,)) if live else self.passed.clear()
        ahead = [r[0] for r in held[len(due):][:1]] + [t + self.span for t in live[-1:]]
        if ahead:
            self._wake(min(ahead))
        if due:
            yield pd.DataFrame({"user_id": [key[0]] * len(due), "id": [r[1] for r in due], "accepted": verdicts})

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def close(self) -> None:
        pass


def rate_limited_stream(requests: DataFrame, limit: int = 3, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """(user_id, id, accepted) of a request stream with columns user_id, id, ts; ties in time go by id.

    A verdict appears once the watermark, ``late`` behind the newest request, has passed its request; requests behind the
    watermark are dropped by Spark.
    """
    rows = requests.withWatermark("ts", late).select("user_id", "id", "ts", F.unix_micros("ts").alias("micros"))
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=RateLimiter(limit, seconds), outputStructType="user_id string, id long, accepted boolean",
        outputMode="Append", timeMode="EventTime")


# ------------------------------------------------------------ cache expiry
class CacheExpiry(StatefulProcessor):
    """Keeps the newest entry per key with a timer at its end; an entry renewed before its end moves the timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", StructType([
            StructField("task_type", StringType()), StructField("created", LongType()), StructField("until", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        held = tuple(self.entry.get()) if self.entry.exists() else None
        arrived = sorted((int(c), int(u), t) for chunk in rows for t, c, u in zip(chunk["task_type"], chunk["created"], chunk["until"]))
        newest, ended = held, []
        for created, until, task in arrived:
            if newest is not None and newest[2] <= created:
                ended.append(newest)
            if newest is None or (created, until) > newest[1:]:
                newest = (task, created, until)
        if newest != held:
            if held is not None:
                self.handle.deleteTimer(held[2])
            self.entry.update(newest)
            self.handle.registerTimer(newest[2])
        if ended:
            yield pd.DataFrame({"cache_key": [key[0]] * len(ended), "task_type": [e[0] for e in ended], "until": [e[2] for e in ended]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        if self.entry.exists():
            task, _, until = self.entry.get()
            if until <= expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
                yield pd.DataFrame({"cache_key": [key[0]], "task_type": [task], "until": [until]})

    def close(self) -> None:
        pass


def expired_entries(entries: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(cache_key, task_type, expires_at) of a stream of cache entries, once time has passed an entry's end.

    Time is that of the entries' ``created_at``, less ``late``. A newer entry of a key replaces the one before and its end; state
    holds live keys alone.
    """
    rows = entries.withWatermark("created_at", late).select(
        "cache_key", "task_type", "created_at", F.unix_millis("created_at").alias("created"), F.unix_millis("expires_at").alias("until"))
    ended = rows.groupBy("cache_key").transformWithStateInPandas(
        statefulProcessor=CacheExpiry(), outputStructType="cache_key string, task_type string, until long", outputMode="Append", timeMode="EventTime")
    return ended.select("cache_key", "task_type", F.timestamp_millis("until").alias("expires_at"))
