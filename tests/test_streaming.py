"""Streaming jobs against sequential expectations."""

import re

from pyspark.sql import functions as F

from newslake.operators import dedup
from newslake.streaming import jobs, store


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_batches(spark, tmp_path, batches, schema, build, take):
    """Feed the batches one after the other into one query with one state, and gather what each of them puts out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    state, source, got = str(tmp_path / "state"), str(tmp_path / "in"), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out: list = []
        query = (build(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("append")
                 .foreachBatch(lambda b, _, o=out: o.extend(take(r) for r in b.collect()))
                 .option("checkpointLocation", state).trigger(availableNow=True).start())
        query.awaitTermination()
        got.append(out)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return got


def _sequential(rows, limit=3, span=60):
    live, want = {}, {}
    for t, i, u in sorted((t, i, u) for i, u, t in rows):
        times = [x for x in live.get(u, []) if t - x < span]
        want[i] = len(times) < limit
        live[u] = times + [t] if want[i] else times
    return want


def test_rate_limit_over_unordered_batches(spark, tmp_path):
    """Requests come out of order within and across batches; verdicts are those of the order of times."""
    rows = [(i, "u" if i % 3 else "v", 90 + i * 9) for i in range(60)]
    mixed = [rows[(i * 7) % 60] for i in range(60)]
    near = sorted(mixed, key=lambda r: (r[2] // 90, r[0] % 5))        # out of order by less than 90 seconds
    batches = [near[:13], near[13:34], near[34:], [(-1, "end", 10_000)], [(-2, "end", 20_000)]]
    build = lambda s: jobs.rate_limited_stream(s.withColumn("ts", F.timestamp_seconds("sec")), late="100 seconds")
    got = _in_batches(spark, tmp_path, batches, "id long, user_id string, sec long", build, lambda r: (r.id, r.accepted))
    verdicts = [v for out in got for v in out if v[0] >= 0]
    assert len(verdicts) == 60 and dict(verdicts) == _sequential(rows) and not all(dict(verdicts).values())
    assert not [v for v in got[0] if rows[v[0]][2] >= max(r[2] for r in batches[0]) - 100]          # nothing is judged before its time has passed


def test_rate_limit_state_ends(spark, tmp_path):
    """After the last request has left the span, only the user that carries the time on holds state."""
    build = lambda s: jobs.rate_limited_stream(s.withColumn("ts", F.timestamp_seconds("sec")), late="0 seconds")
    batches = [[(1, "a", 10), (2, "b", 11), (3, "a", 12)], [(4, "end", 1000)], [(5, "end", 5000)]]
    _in_batches(spark, tmp_path, batches, "id long, user_id string, sec long", build, lambda r: r.id)
    held = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "passed").load()
    assert {r.key.user_id for r in held.select("key").collect()} <= {"end"}


def test_sliding_counts_over_batches(spark, tmp_path):
    """Each ended window comes once, with events of several batches in it."""
    rows = [("a", "success", 0), ("a", "error", 3700), ("b", "drop_old", 3600), ("a", "success", 7300)]
    batches = [rows[:2], rows[2:], [("end", "", 10**7)], [("end", "", 2 * 10**7)]]
    build = lambda s: jobs.sliding_event_counts(s.withColumn("created_at", F.timestamp_seconds("sec")), "3 hours", "1 hour", "2 hours")
    got = _in_batches(spark, tmp_path, batches, "source string, event_type string, sec long", build,
                      lambda r: (r.source, int(r.window.start.timestamp()) // 3600, r.success_count, r.error_count, r.drop_old_count))
    flat = sorted(v for out in got for v in out if v[0] != "end")
    want = {}
    for source, kind, sec in rows:
        for start in range(sec // 3600 - 2, sec // 3600 + 1):
            counts = want.setdefault((source, start), [0, 0, 0])
            counts[["success", "error", "drop_old"].index(kind)] += 1
    assert flat == sorted((s, h, *c) for (s, h), c in want.items())


def test_key_index_over_many_batches(spark, tmp_path):
    """Keys of all earlier batches are found, those of the batch itself are not, and folders stay few."""
    index = store.KeyIndex(spark, str(tmp_path / "keys"), buckets=4, fan_in=3)
    one = lambda *ks: spark.createDataFrame([("g", k) for k in ks], "kind string, key string")
    for n in range(11):
        for _ in range(2 if n in (3, 9, 10) else 1):                  # some batches are repeated
            index.merge(n)
            asked = one(*[f"k{i}" for i in range(n + 1)], "other")
            assert {r.key for r in index.seen(asked, n).collect()} == {f"k{i}" for i in range(n)}
            index.add(one(f"k{n}"), n)
    assert [f.split("keys/")[1] for f in index.folders(11)] == ["level=0/part=9", "level=0/part=10", "level=2/part=0"]
    assert all(len(index.folders(n)) <= 2 * 3 for n in range(27))
    assert "bucket" in _partition_filters(index.seen(one("k1"), 11))


def _partition_filters(df):
    return re.findall(r"PartitionFilters: \[[^\]]*\]", df._jdf.queryExecution().toString())[0]


def test_dated_store_reads_the_days_asked_for(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-05 10:00:00"), (3, None)], "id long, p string").select(
        "id", F.col("p").cast("timestamp").alias("published_at"))
    kept = store.DatedStore(spark, str(tmp_path / "rows"), rows.schema)
    start = F.lit("2024-01-04 00:00:00").cast("timestamp")
    assert kept.since(start, 5).count() == 0
    for batch_id in (0, 0, 1):
        kept.write(rows.where(F.col("id") <= 2 + batch_id), batch_id)
    assert [r.id for r in kept.since(start, 1).collect()] == [2]
    assert sorted(r.id for r in kept.of_batch(1).collect()) == [1, 2, 3]
    assert "2024-01-04" in _partition_filters(kept.since(start, 9))    # the day is a constant of the scan


def test_deliveries_once_over_batches(spark, tmp_path):
    handle = jobs.delivery_handler(spark, str(tmp_path / "log"))
    rows = lambda *p: spark.createDataFrame([(u, n, "t") for u, n in p], "user_id string, news_id long, delivered_at string")
    for batch_id, pairs in ((0, [("u:1", 1), ("u:1", 1)]), (0, [("u:1", 1)]), (1, [("u:1", 1), ("1", 1), ("u", 11)]), (2, [("1", 1), ("u", 12)])):
        handle(rows(*pairs), batch_id)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted((r.user_id, r.news_id) for r in log.collect()) == [("1", 1), ("u", 11), ("u", 12), ("u:1", 1)]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, 1, "g1", "h1"), (2, 2, "g1", "h2"), (3, 3, "g3", "h3")],
                                  "id long, arrival_idx long, guid string, url_hash string")
    path = str(tmp_path / "store")
    handle = jobs.unseen_handler(spark, path)
    for batch_id in (0, 0, 1, 1):
        handle(batch, batch_id)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]


def test_late_and_early_rows_are_logged(spark, tmp_path):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    rows = [(1, "2024-01-30 20:00:00"), (2, "2024-01-20 00:00:00"), (3, "2024-01-31 01:00:00")]
    batch = spark.createDataFrame(rows, "id long, p string").select(
        "id", F.col("id").alias("arrival_idx"), F.concat(F.lit("https://s.example.com/"), F.col("id").cast("string")).alias("url"),
        F.lit("s").alias("source"), F.concat(F.lit("A headline about item "), F.col("id").cast("string")).alias("title"),
        F.concat(F.lit("body text of item number "), F.col("id").cast("string")).alias("clean_text"),
        F.col("p").cast("timestamp").alias("published_at"), F.col("p").cast("timestamp").alias("fetched_at"), F.lit("g").alias("guid"))
    store, drops = str(tmp_path / "store"), str(tmp_path / "drops")
    jobs.ingest_handler(spark, store, drops, lambda _: now)(batch, 0)
    assert [r.id for r in spark.read.parquet(store).collect()] == [1]
    assert {(r.id, r.event_type) for r in spark.read.parquet(drops).collect()} == {(2, "drop_old"), (3, "drop_date")}


def test_cache_expiry_over_batches(spark, tmp_path):
    """An entry ends when time passes its end; one renewed in a later batch lives on; nothing ends twice."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "cache_key string, task_type string, created long, until long"
    batches = [
        [("a", "x", 1, 100), ("b", "x", 1, 150), ("c", "y", 1, 1000)],
        [("a", "x", 90, 400), ("late", "x", 120, 130)],          # a is renewed before its end
        [("d", "x", 200, 900), ("b", "z", 190, 210)],             # b comes back after its end
        [("e", "x", 500, 2000), ("e", "x", 499, 501)],            # the older of two entries does not count
    ]
    state, source = str(tmp_path / "state"), str(tmp_path / "in")
    got = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumns(
            {"created_at": F.timestamp_seconds("created"), "expires_at": F.timestamp_seconds("until")})
        found = jobs.expired_entries(stream).withColumn("end", F.unix_seconds("expires_at"))
        query = (found.writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend((r.cache_key, r.task_type, r.end) for r in b.collect()))
                 .option("checkpointLocation", state).trigger(availableNow=True).start())
        query.awaitTermination()
    assert sorted(got) == [("a", "x", 400), ("b", "x", 150), ("b", "z", 210), ("late", "x", 130)]


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    """A table is a file or a folder of files, and one without rows gives a stream without batches."""
    rows = spark.range(0, 40, 1, 4).select("id", F.concat(F.lit("u"), F.col("id")).alias("url"))
    rows.write.parquet(str(tmp_path / "many.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "tmp"))
    next((tmp_path / "tmp").glob("*.parquet")).rename(tmp_path / "one.parquet")
    rows.where("id < 0").write.parquet(str(tmp_path / "none.parquet"))
    drained = lambda name: jobs.drain(jobs.read_table_stream(spark, str(tmp_path), name), name)
    for name, n in (("many", 40), ("one", 40), ("none", 0)):
        assert sorted(r.id for r in drained(name).select("id", "url", "batch_id").collect()) == list(range(n))
    none = store.read_batches(spark, str(tmp_path / "absent"), "id long, url string").select("id", "url")
    assert none.count() == 0


def test_near_duplicates_over_batches(spark, tmp_path, monkeypatch):
    """Rows fall to near rows of earlier batches and of their own; equal fingerprints are never linked with each other."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    rows = [(i, (1 << 40) if i % 3 else (1 << 20) - 1 << i % 40) for i in range(300)] + [(300, None), (301, None)]
    df = spark.createDataFrame(rows, "id long, simhash long").select(
        "id", F.col("id").alias("arrival_idx"), F.lit("2024-01-30 20:00:00").cast("timestamp").alias("published_at"), "simhash")
    kept = []
    for r in rows:
        if r[1] is None or not any(k[1] is not None and bin(k[1] ^ r[1]).count("1") <= 6 for k in kept):
            kept.append(r)
    links, written = [], dedup._written

    def count(frame, **counts):
        done, seen = written(frame, **counts)
        links.extend([seen["open"]] if done.columns == ["e", "l"] else [])
        return done, seen

    monkeypatch.setattr(dedup, "_written", count)
    path = str(tmp_path / "store")
    handle = jobs.near_duplicate_handler(spark, path, now)
    for batch_id, (low, high) in enumerate(((0, 200), (0, 200), (200, 400))):
        handle(df.where(f"id >= {low} AND id < {high}"), max(0, batch_id - 1))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [r[0] for r in kept]
    assert max(links) < 400


def test_a_tick_without_a_wanted_category_computes_none_for_its_keys(spark):
    from newslake.plans import ingest

    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    rows = spark.range(4).select(
        "id", F.col("id").alias("arrival_idx"), F.concat(F.lit("headline of item number "), "id").alias("title"), F.col("id").cast("string").alias("guid"),
        F.col("id").cast("string").alias("url_hash"), F.col("id").cast("string").alias("checksum"), F.col("id").cast("string").alias("url_normalized"),
        F.xxhash64("id").alias("simhash"), (now - F.expr("interval 30 hours")).alias("published_at"))
    broken = rows.withColumn("category", F.raise_error(F.lit("category was computed")).cast("string"))
    assert ingest.publishable_ids(broken, rows.limit(0), now).count() == 4
    odd = rows.withColumn("category", F.when(F.col("id") % 2 == 1, "world").otherwise("moscow"))
    assert sorted(r.id for r in ingest.publishable_ids(odd, rows.limit(0), now, "world").collect()) == [1, 3]
