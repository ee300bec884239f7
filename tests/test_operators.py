"""Operators against sequential brute force on small fixtures."""

import random
import time

import pytest
from pyspark.sql import functions as F

from newslake.functions import text as tx
from newslake.operators import audit, candidates, dedup, gates, health, limits, ordered, routing, usage
from newslake.sources import sinks

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def words(title):
    import re
    from newslake.functions.lexicon import TITLE_STOPWORDS
    norm = " ".join(re.sub(r"[^\w\s]", "", title.lower()).split())
    return norm, {w for w in norm.split() if len(w) > 2 and w not in TITLE_STOPWORDS}


def title_match(new, old, t=0.85):
    (a, wa), (b, wb) = words(new), words(old)
    if len(wa) < 3 or len(wb) < 3:
        return False
    return a == b or (len(a) > 40 and (a in b or b in a)) or len(wa & wb) / len(wa | wb) >= t


@pytest.fixture(scope="module")
def batch():
    rng = random.Random(7)
    vocab = "мэр город власти строят новую станцию метро дорога парк река школа театр завод рынок закон суд банк спорт матч".split()
    titles, prints = [], []
    for i in range(260):
        if titles and rng.random() < 0.45:
            base = titles[rng.randrange(len(titles))].split()
            kind = rng.randrange(4)
            if kind == 0:
                base = base[:-1] + [rng.choice(vocab)]
            elif kind == 1:
                base = base + [rng.choice(vocab)]
            elif kind == 2 and len(base) > 5:
                base = base[1:]
            else:
                base = [base[0] + "а", *base[1:]]
            titles.append(" ".join(base))
        else:
            titles.append(" ".join(rng.sample(vocab, rng.randrange(3, 14))))
        if prints and rng.random() < 0.5:
            h = prints[rng.randrange(len(prints))]
            for _ in range(rng.randrange(0, 9)):
                h ^= 1 << rng.randrange(64)
            prints.append(h)
        else:
            prints.append(rng.getrandbits(64))
    signed = [h - (1 << 64) if h >> 63 else h for h in prints]
    return [(i, i, f"g{i // 2}" if i % 17 == 0 else f"u{i}", titles[i], signed[i], i % 40) for i in range(260)]


@pytest.fixture(scope="module")
def items(spark, batch):
    df = spark.createDataFrame(batch, "id long, arrival_idx long, guid string, title string, simhash long, age int")
    return df.withColumn("published_at", now() - F.make_dt_interval(hours=F.col("age"))).cache()


def distance(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


@pytest.mark.parametrize("blocks", [7, 8, 9])
def test_block_masks_never_miss(blocks):
    rng = random.Random(blocks)
    masks = dedup.block_masks(blocks)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 6):
            b ^= 1 << bit
        assert any((a & m & (2**64 - 1)) == (b & m & (2**64 - 1)) for m in masks)


@pytest.mark.parametrize("runs", [2, 3, 4, 7])
def test_near_stored(items, batch, runs):
    new, old = items.filter("id >= 130"), items.filter("id < 130")
    want = {r[0] for r in batch[130:] if any(distance(r[4], o[4]) <= 6 for o in batch[:130])}
    got = {r.id for r in dedup.near_stored(new, old, runs=runs).select("id").collect()}
    assert got == want
    rest = {r.id for r in dedup.not_near_stored(new, old, runs=runs).select("id").collect()}
    assert rest == {r[0] for r in batch[130:]} - want


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.85])
def test_similar_titles(items, batch, threshold):
    want = {r[0] for r in batch[130:] if any(title_match(r[3], o[3], threshold) for o in batch[:130])}
    got = {r.id for r in dedup.similar_titles(items.filter("id >= 130"), items.filter("id < 130"), threshold).select("id").collect()}
    assert got == want and want


@pytest.mark.parametrize("depth", [2, 256])
def test_greedy_keep_first(items, batch, depth):
    kept = []
    for r in batch:
        clash = any(r[2] == k[2] or distance(r[4], k[4]) <= 6 or (k[5] < 24 and title_match(r[3], k[3])) for k in kept)
        if not clash:
            kept.append(r)
    slim = items.select("id", "arrival_idx", "guid", "simhash", "published_at",
                        dedup.squeeze(tx.normalized_title("title")).alias("norm"), tx.title_words("title").alias("tokens"))
    slim = slim.withColumn("tokens", F.array_sort("tokens"))
    families = [dedup.guid_family(), dedup.fingerprint_family(), *dedup.title_families(now(), 0.85)]
    got = {r.id for r in dedup.greedy_keep_first(slim, families, depth=depth).select("id").collect()}
    assert got == {r[0] for r in kept}
    assert len(kept) < len(batch)


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_probes_reach_every_near_value(radius):
    """Every way to flip up to ``radius`` bits is reached through some run."""
    rng = random.Random(radius)
    for runs in (1, 3, 4, 7) if radius else (1, 3):
        masks = [(m & (1 << 64) - 1, {f & (1 << 64) - 1 for f in flips}) for m, flips in dedup.probe_masks(runs, min(radius, 3) if runs == 1 else radius)]
        assert sum(m for m, _ in masks) == (1 << 64) - 1
        for _ in range(300):
            bits = rng.sample(range(64), rng.randint(0, min(radius, 3) if runs == 1 else radius))
            flip = sum(1 << b for b in bits)
            assert any(flip & m in flips for m, flips in masks)


def test_copies_leave_one_row_each(spark):
    """Classes of equal rows, rows that share a guid alone, and rows without a fingerprint, against the sequential rule."""
    rng = random.Random(17)
    heads = [f"{a} report about {b} {c} today" for a in ("daily", "late") for b in ("river", "market", "council") for c in ("flood", "prices")]
    rows = []
    for i in range(260):
        title = rng.choice(heads) if rng.random() < 0.7 else f"single story number {i} of many"
        simhash = rng.choice([None, 0, 1, 127, 1 << 40, (1 << 40) + 255, rng.getrandbits(60)])
        rows.append((i, 1000 + i, rng.choice(["", f"g{rng.randrange(40)}", f"own{i}"]), title, simhash, rng.choice([1, 30])))
    df = spark.createDataFrame(rows, "id long, arrival_idx long, guid string, title string, simhash long, hours int")
    df = df.withColumn("published_at", now() - F.make_dt_interval(hours=F.col("hours")))
    kept = []
    for r in rows:
        if not any((r[2] and r[2] == k[2]) or (r[4] is not None and k[4] is not None and distance(r[4], k[4]) <= 6)
                   or (k[5] < 24 and title_match(r[3], k[3])) for k in kept):
            kept.append(r)
    got = sorted(r.id for r in dedup.near_duplicate_resolution(df, now()).select("id").collect())
    assert got == [r[0] for r in kept] and len(got) < 200


def test_levels_of_keep_first_are_one_job_each(spark):
    """A chain of n conflicts takes n levels, each with one write; a key beyond the depth takes rounds, and nothing is lost."""
    chain = [(i, i, f"{i // 2}", f"{(i + 1) // 2}") for i in range(12)]  # each row conflicts with its neighbours alone
    df = spark.createDataFrame(chain, "id long, arrival_idx long, a string, b string")
    families = [dedup.Family(c, [(0, F.array(c))], {}, F.lit(True)) for c in ("a", "b")]
    assert sorted(r.id for r in dedup.greedy_keep_first(df, families).select("id").collect()) == list(range(0, 12, 2))
    rounds = []
    same = spark.range(500).select("id", F.col("id").alias("arrival_idx"), F.lit("k").alias("a"))
    got = dedup.greedy_keep_first(same, families[:1], depth=4, on_round=lambda r, n: rounds.append(n)).collect()
    assert [r.id for r in got] == [0] and rounds == [500, 0]
    far = [dedup.Family("a", [(0, F.array("a"))], {}, F.lit(False))]
    rounds.clear()
    assert dedup.greedy_keep_first(same, far, depth=200, on_round=lambda r, n: rounds.append(n)).count() == 500
    assert rounds == [500, 300, 100, 0]


def _counting_links(monkeypatch):
    """Collects how many links each step of keep-first writes."""
    links, written = [], dedup._written

    def count(df, **counts):
        done, seen = written(df, **counts)
        if done.columns == ["e", "l"]:
            links.append(seen["open"])
        return done, seen

    monkeypatch.setattr(dedup, "_written", count)
    return links


@pytest.mark.parametrize("first,growth", [(7, 2), (50, 3), (1000, 8)])
def test_prefixes_decide_as_the_sequential_rule(items, batch, first, growth):
    kept = []
    for r in batch:
        if not any(r[2] == k[2] or distance(r[4], k[4]) <= 6 or (k[5] < 24 and title_match(r[3], k[3])) for k in kept):
            kept.append(r)
    slim = items.select("id", "arrival_idx", "guid", "simhash", "published_at",
                        dedup.squeeze(tx.normalized_title("title")).alias("norm"), F.array_sort(tx.title_words("title")).alias("tokens"))
    families = [dedup.guid_family(), dedup.fingerprint_family(), *dedup.title_families(now(), 0.85)]
    got = sorted(r.id for r in dedup.keep_first_by_prefixes(slim, families, first, growth).collect())
    assert got == [r[0] for r in kept]


def test_links_do_not_grow_with_the_square_of_a_cluster(spark, monkeypatch):
    """Ten clusters of near fingerprints: rows after a prefix fall to what it kept, and are never linked with each other."""
    rng = random.Random(5)
    centres = [rng.getrandbits(62) for _ in range(10)]
    rows = [(i, i if i % 97 else None, rng.choice(centres) ^ 1 << rng.randrange(62) ^ 1 << rng.randrange(62)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, arrival_idx long, simhash long")
    kept = []
    for r in rows:
        if r[1] is None or not any(distance(r[2], k[2]) <= 6 for k in kept if k[1] is not None):
            kept.append(r)
    links = _counting_links(monkeypatch)
    got = sorted(r.id for r in dedup.keep_first_by_prefixes(df, [dedup.fingerprint_family()], first=64).collect())
    assert got == [r[0] for r in kept]
    assert max(links) < 2000 and len(kept) < 60


def test_keys_of_titles_inside_titles(spark):
    """A title and any title that holds it share a key, and a title shows fewer than two keys per word."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    rows = []
    for i in range(300):
        whole = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        n = rng.randint(3, len(whole))
        at = rng.randint(0, len(whole) - n)
        part = whole[at:at + n]
        part[0], part[-1] = part[0][rng.randrange(len(part[0])):], part[-1][:rng.randint(1, len(part[-1]))]
        rows.append((" ".join(whole), " ".join(part)))
    df = spark.createDataFrame(rows, "whole string, part string")
    out = df.select("whole", "part", dedup.inner_keys(F.col("whole"), False).alias("w"), dedup.inner_keys(F.col("part"), True).alias("p")).collect()
    for r in out:
        assert r.part in r.whole and set(r.p) & set(r.w) and len(r.p) == 1
        assert len(r.w) < 2 * len(r.whole.split(" "))
    assert [r.w for r in spark.createDataFrame([("one two",), ("",)], "t string").select(dedup.inner_keys(F.col("t"), False).alias("w")).collect()] == [[], []]


def test_sketches_differ_in_no_more_bits_than_titles_in_words(spark):
    rng = random.Random(2)
    pairs = [([f"w{rng.randrange(60)}" for _ in range(20)], [f"w{rng.randrange(60)}" for _ in range(20)]) for _ in range(100)]
    pairs += [(a, a[:-1]) for a, _ in pairs[:20]]
    df = spark.createDataFrame([(sorted(set(a)), sorted(set(b))) for a, b in pairs], "a array<string>, b array<string>")
    sides = [dedup.title_sketch(F.col(c)) for c in ("a", "b")]
    bits = sum((dedup.fp.hamming(x, y) for x, y in zip(sides[0].values(), sides[1].values())), F.lit(0))
    got = [(len(set(r.a) ^ set(r.b)), r.bits) for r in df.select("a", "b", bits.alias("bits")).collect()]
    assert all(d <= n and d % 2 == n % 2 for n, d in got) and max(d for _, d in got) > 10


def test_staged_first_wins(spark):
    rng = random.Random(3)
    rows = [(i, i, f"T{rng.randrange(60)}", rng.choice(["", f"h{rng.randrange(50)}"]), rng.choice(["", f"c{rng.randrange(50)}"]), f"n{rng.randrange(70)}")
            for i in range(200)]
    df = spark.createDataFrame(rows, "id long, arrival_idx long, title string, url_hash string, checksum string, url_normalized string")
    seen, want = [set(), set(), set(), set()], []
    for r in rows:
        ok = True
        for j, key in enumerate((r[2].lower(), r[3], r[4], r[5])):
            if j and not key:
                continue
            if key in seen[j]:
                ok = False
                break
            seen[j].add(key)
        if ok:
            want.append(r[0])
    assert sorted(r.id for r in dedup.staged_first_wins(df).select("id").collect()) == want


def test_checksum_window(spark):
    store = spark.createDataFrame([("abc123", NOW)], "checksum string, p string").select("checksum", F.col("p").cast("timestamp").alias("published_at"))
    new = spark.createDataFrame([(1, "abc123"), (2, "def456")], "id long, checksum string")
    assert [r.id for r in dedup.unseen_checksums(new, store, now()).collect()] == [2]


def _stream(spark, n=400, seed=5):
    rng = random.Random(seed)
    t, rows = 0.0, []
    for i in range(n):
        t += rng.choice([1, 5, 20, 59, 60, 61, 700, 601, 600, 5000])
        rows.append((i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", t))
    df = spark.createDataFrame(rows, "id long, k string, sec double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sec")))
    return rows, df


@pytest.mark.parametrize("width", [60, 3600, 10**6])
def test_gap_sessions(spark, width):
    rows, df = _stream(spark)
    last, streak, want = {}, {}, {}
    for i, k, t in rows:
        streak[k] = 1 if k not in last or t - last[k] > 600 else streak[k] + 1
        last[k] = t
        want[i] = streak[k]
    got = ordered.rank_in_gap_sessions(df, "k", "ts", "id", 600, width=width)
    assert {r.id: r.streak_no for r in got.collect()} == want


@pytest.mark.parametrize("width", [60, 10**6])
def test_last_value_before(spark, width):
    rows, df = _stream(spark)
    state, want = {}, {}
    for i, k, _ in rows:
        want[i] = state.get(k)
        if i % 5 == 0:
            state[k] = i
    got = ordered.last_value_before(df.withColumn("v", F.when(F.col("id") % 5 == 0, F.col("id"))), "k", "ts", "id", "v", "prev", width=width)
    assert {r.id: r.prev for r in got.collect()} == want


@pytest.mark.parametrize("width", [60, 300, 3600])
def test_rate_limit(spark, width):
    rng = random.Random(9)
    t, rows, live, want = 0, [], {}, {}
    for i in range(500):
        t += rng.choice([0, 1, 2, 7, 15, 30, 61 if i % 50 == 0 else 3])
        u = "hot" if rng.random() < 0.8 else "other"
        rows.append((i, u, t))
        times = [x for x in live.get(u, []) if t - x < 60]
        want[i] = len(times) < 3
        live[u] = times + [t] if want[i] else times
    df = spark.createDataFrame(rows, "id long, user_id string, sec long").withColumn("ts", F.timestamp_seconds(F.col("sec")))
    got = limits.rate_limited(df, 3, 60, width=width)
    assert {r.id: r.accepted for r in got.collect()} == want


def test_tick_gate(spark):
    rng = random.Random(1)
    tasks = ["summary", "cleanup", "hashtags_ai", "translate"]
    rows = [(tick, n, rng.choice(tasks)) for tick in range(30) for n in range(rng.randrange(1, 15))]
    allowed, off = {}, {}
    for tick, n, task in rows:
        gone = off.setdefault(tick, [])
        ok = task not in gone and sum(allowed.get((tick, m), False) for m in range(n)) < 4
        allowed[tick, n] = ok
        if not ok and task not in gone and len(gone) < 3:
            gone.append(("summary", "cleanup", "hashtags_ai")[len(gone)])
    df = spark.createDataFrame(rows, "tick_id long, call_no long, task string")
    assert {(r.tick_id, r.call_no): r.allowed for r in limits.gate_calls(df, 4).collect()} == allowed
    got = {r.tick_id: list(r.disabled) for r in limits.disabled_tasks(df, 4).collect()}
    assert got == {k: sorted(v) for k, v in off.items() if v}
    two = spark.createDataFrame([(1, i, x) for i, x in enumerate(["summary", "cleanup", "summary", "cleanup", "hashtags_ai"])], df.schema)
    assert limits.disabled_tasks(two, 2).collect()[0].disabled == ["cleanup", "hashtags_ai", "summary"]


def test_budget(spark):
    day = spark.createDataFrame([("d", 50, 40, 0.8)], "date string, tokens_in long, tokens_out long, cost_usd double")
    assert usage.budget_state(day, 1.0, 0.25).collect()[0].budget_state == "DEGRADED"
    assert usage.budget_state(day, 0.0, 0.0, 100, 20).collect()[0].degraded_features == ["cleanup", "hashtags_ai", "summary"]
    assert usage.budget_state(day, 2.0, 0.25, 200).collect()[0].budget_state == "OK"


def test_enabled_sources(spark):
    sources = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, code string")
    users = spark.createDataFrame([("u",)], "user_id string")
    steps = [([], [1, 2, 3]), ([1], [2, 3]), ([1, 2], [3]), ([2], [1, 3])]
    for off, want in steps:
        settings = spark.createDataFrame([("u", i, False, "prod") for i in off], "user_id string, source_id long, enabled boolean, env string")
        assert routing.enabled_sources(users, settings, sources).collect()[0].source_ids == want
    pairs = spark.createDataFrame([("u", i, s) for i, s in enumerate(["a", "b", "c", "x"])], "user_id string, news_id long, source string")
    assert {r.source for r in routing.visible(pairs, settings, sources).collect()} == {"a", "c", "x"}


def test_pause_and_delivery(spark):
    log = spark.createDataFrame([(1, "u", 1, True, False), (2, "u", 2, True, True)], "id long, user_id string, s long, sets_pause boolean, is_paused boolean")
    row = routing.pause_states(log.withColumn("ts", F.timestamp_seconds("s"))).collect()[0]
    assert (row.pause_version, row.is_paused) == (2, True)
    twice = spark.createDataFrame([("u", 1, 5), ("u", 1, 6)], "user_id string, news_id long, s long").withColumn("delivered_at", F.timestamp_seconds("s"))
    first = routing.new_deliveries(twice, twice.limit(0))
    assert first.count() == 1 and routing.new_deliveries(twice, first).count() == 0


def test_pending_with_gaps(spark):
    rng = random.Random(2)
    ids = sorted(rng.sample(range(1, 400_000), 300))
    rows = [(i, rng.choice(["world", "russia"]), rng.randrange(60)) for i in ids]
    items = spark.createDataFrame(rows, "id long, category string, age int").withColumn("published_at", now() - F.make_dt_interval(hours=F.col("age"))) \
        .withColumns({"fetched_at": F.col("published_at"), "domain": F.lit("d"), "source": F.lit("s")})
    users = [(f"u{k}", k % 2 and "world" or None, rng.choice([0, None, rng.randrange(400_000), 500_000])) for k in range(20)]
    prefs = spark.createDataFrame(users, "user_id string, category_filter string, last_delivered_news_id long")
    want = set()
    for u, cat, last in users:
        page = [r for r in rows if r[0] > (last or 0)][:50]
        want |= {(u, r[0]) for r in page if r[2] <= 36 and (cat is None or r[1] == cat)}
    assert {(r.user_id, r.id) for r in routing.pending(items, prefs, now()).collect()} == want


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    rows = ordered.global_row_number(df, ["v"], "n", 10).orderBy("v").collect()
    assert [r.n for r in rows] == list(range(11, 1011))


def test_freshness(one):
    def reason(at=None, date=None, fetched=None, domain="d", bad=False):
        ts = lambda x: F.lit(x).cast("timestamp")
        return one(gates.freshness_reason(now(), ts(at), F.lit(date).cast("string"), ts(fetched), F.lit(domain), F.lit(bad)))

    assert reason(at="2024-01-30 12:00:00") is None
    assert reason(at="2024-01-29 11:59:59") == "OLD_PUBLISHED_AT"
    assert reason(at="2024-01-25 00:00:00", domain="new-science.ru") is None
    assert reason(at="2024-01-31 00:05:01") == "PARSE_DATE_FAILED" and reason(at="2024-01-31 00:05:00") is None
    assert reason() == "NO_PUBLISHED_DATE" and reason(bad=True) == "PARSE_DATE_FAILED"
    assert reason(date="junk") == "PARSE_DATE_FAILED" and reason(date="2024-01-30") is None
    assert reason(fetched="2024-01-30 20:00:00") is None


def test_event_counts_zero_filled(spark):
    events = spark.createDataFrame([(1, "a", "success", None, NOW)], "id long, source string, event_type string, error_code string, c string")
    events = events.withColumn("created_at", F.col("c").cast("timestamp"))
    board = {r.source: r.success_count for r in health.event_counts(events, spark.createDataFrame([("a",), ("b",)], "source string"), now()).collect()}
    assert board == {"a": 1, "b": 0}


def test_export_headers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "https://example.com", "Test", "example.com", "world", "Text")], "id long, url string, title string, source string, category string, clean_text string")
    rows = gates.export_rows(df.withColumn("published_at", now()))
    assert rows.columns == ["Дата", "Время", "Источник", "Ссылка", "Заголовок", "Содержание новости", "Хештеги"]
    assert rows.collect()[0]["Хештеги"] == "#Мир"
    sinks.write_export(df.withColumn("published_at", now()), str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == 1
    updated = sinks.update_columns(df, spark.createDataFrame([(1, "new")], "id long, title string"), "id", ["title"])
    assert updated.collect()[0].title == "new"
    status = audit.overall_status(spark.createDataFrame([("OK",)], "status string"), F.count("*") > 0).collect()[0]
    assert status.overall_status == "normal"


def test_feed_files(spark, tmp_path):
    from newslake.sources import catalog, feeds
    items = "".join(f"<item><title>Title {i}</title><link>https://e.com/{i}</link><pubDate>Tue, 30 Jan 2024 10:00:00 +0000</pubDate></item>" for i in range(12))
    (tmp_path / "feed.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    rows = feeds.entries_to_items(feeds.read_feed_files(spark, str(tmp_path / "feed.xml"))).collect()
    assert len(rows) == 10 and rows[0].guid == rows[0].url and rows[0].published_confidence == "high"
    (tmp_path / "a.log").write_text("\n".join(["x ERROR y"] * 3 + ["ok"] * 500 + ["z WARNING"]))
    log = audit.log_summary(catalog.read_log_files(spark, [str(tmp_path / "a.log")])).collect()[0]
    assert (log.errors, log.warnings) == (0, 1)


def test_tag_candidates_of_a_text_full_of_names(spark):
    """Each name of a text is taken up once, so that a long text costs its length."""
    name = lambda i: "".join(chr(97 + int(d)) for d in f"{i:06d}").capitalize()
    body = ". ".join(name(i % 30000) for i in range(60000))
    start = time.time()
    got = candidates.tag_candidates(spark.createDataFrame([(1, "No title", body)], "id long, title string, body string"), "en").collect()[0]
    assert got["candidates"][:2] == ["#Aaaaaa", "#Aaaaab"] and len(got["candidates"]) == 20 and time.time() - start < 60
