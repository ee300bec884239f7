import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import brute
import __spark_entry__ as entry
from compare import connect, difference
from newslake.llm import bpe, chat, graph, langid, licenses, mixing, neardup, quality, queries, shingles, suffixdedup, topk, urlfilter

PATH = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path(queries.VOCABULARY)


def sort(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, checkpoints, con, name):
    assert difference(queries.QUERIES[name](spark, PATH), con, queries.SQL[name]) is None


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


def test_near_dedup_query(spark, checkpoints, texts):
    assert sort(queries.op3_minhash_near_dedup(spark, PATH).collect()) == sort(brute.near(texts))


def test_repeated_bytes_query(spark, checkpoints, texts):
    assert sort(queries.op6_suffix_array_dedup(spark, PATH).collect()) == sort(brute.repeated_bytes(texts))


def test_license_query(spark, checkpoints, texts):
    rules = licenses.rules()
    got = queries.op4_license_scans(spark, PATH).drop("score", "n_detections").collect()
    assert sort(got) == sort((d, *brute.licenses(t, rules)) for d, t in texts)


def test_bpe_query(spark, checkpoints, texts):
    tokens = bpe.load_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = []
    for d, t in texts:
        ids = encoding.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sort(queries.op8_byte_level_bpe(spark, PATH).collect()) == sort(want)


def test_mixing_query(spark, checkpoints):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    sizes = Counter()
    for r in docs.select("source", "text").collect():
        sizes[r.source] += len(brute.SPACE_WORD.findall(r.text or ""))
    want = brute.shares(dict(sizes))
    rows = mixing.mix(docs).collect()
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sort(queries.op1_mixing_sources(spark, PATH).collect()) == sort(queries.op1_mixing_sources(spark, PATH).collect())


def test_language_query_on_held_out_documents(spark, checkpoints):
    langs = spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language_id(spark, PATH).join(langs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


# --- nulls, empty and long texts, copies, repeated rows and ids, clashing columns, empty tables


def test_quality_on_odd_rows(odd, none, odd_rows):
    got = quality.report(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sort(got) == sort((r[0], *brute.quality(r[1])) for r in odd_rows)
    assert quality.report(none).collect() == [] and quality.keep(none).columns == none.columns
    kept = {r.doc_id: r for r in quality.keep(odd).select("doc_id", "text", "kept", "q_kept").collect()}
    assert 4 not in kept and 5 not in kept and 12 not in kept and kept[1].kept == "mine"
    assert kept[14].text == dict((r[0], r[1]) for r in odd_rows)[1]


@pytest.mark.parametrize("line, fails", [
    ("A plain sentence of prose that goes on.", False), ("a long line of words without an end mark", False), ("Short end.", False), ("two words", True),
    ("Home | News | Sport | Contact", True), ("We use cookies; see our cookie policy for all details.", True), ("A!! B!! C!! D!!", True),
    ("### *** $$$ a b c d e f", True), ("", False), ("   ", False), ("Read more", True), ("Privacy matters to people who write prose.", False),
])
def test_line_rules(spark, checkpoints, line, fails):
    df = spark.createDataFrame([(line,)], "text string")
    row = df.select(quality.clean_lines(F.col("text"), F.regexp_count("text", F.lit(quality.SYMBOL))).alias("t")).first()
    assert (row.t == line) == (not fails or line == "")


def test_near_dedup_on_odd_rows(odd, none, odd_rows):
    assert sort(neardup.report(odd).collect()) == sort(brute.near([r[:2] for r in odd_rows]))
    assert neardup.report(none).collect() == [] and neardup.keep(none).collect() == []
    kept = neardup.keep(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None])


def test_near_dedup_links_chains_and_blocks(spark, checkpoints):
    rng = random.Random(5)
    words = [f"v{rng.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(60):  # each differs a little from the one before, the ends differ much
        words[rng.randrange(400)] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, f"only here {i} " + " ".join(f"u{rng.randrange(900)}" for _ in range(50))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole, neardup.BLOCK = neardup.BLOCK, 7
    try:
        assert sort(neardup.report(df).collect()) == sort(brute.near(rows))
    finally:
        neardup.BLOCK = whole


def test_signature_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (900, 50, 50))
    _, low = neardup.Signer().sign([np.unique(np.concatenate([common, x])) for x in (a, b)])
    agree = (low[0] == low[1]).mean()
    assert abs((agree - 1 / 256) / (1 - 1 / 256) - 0.9) < 0.08


def test_shingles_ignore_where_texts_are_cut(monkeypatch):
    text = ("Ab cd\tEf\ngh  ij " * 500).encode()
    whole = shingles.batch_words([text, b"", b"x"])
    monkeypatch.setattr(shingles, "PIECE", 64)
    parts = shingles.batch_words([text, b"", b"x"])
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) == 2500 and len(whole[1]) == 0


def test_repeated_bytes_on_odd_rows(odd, none, odd_rows):
    assert sort(suffixdedup.report(odd).collect()) == sort(brute.repeated_bytes([r[:2] for r in odd_rows]))
    assert suffixdedup.report(none).collect() == []
    left = suffixdedup.stripped(odd)
    assert left.columns == odd.columns and left.count() == len(odd_rows)


def test_repeated_bytes_with_edits_periods_and_bounds(spark, checkpoints):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = letters(700)
    rows = [(0, letters(100) + shared + letters(300)), (1, shared[:400] + "X" + shared[401:]), (2, letters(50) + shared[100:299] + letters(50)),
            (3, letters(50) + shared[100:302] + letters(50)), (4, "abc" * 300), (5, letters(199)), (6, "é" * 150), (7, shared[350:] + shared[:250])]
    rows += [(20 + i, letters(30) + shared[20 * i:20 * i + 230] + letters(30)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sort(suffixdedup.report(df).collect()) == sort(brute.repeated_bytes(rows))


def test_licenses_on_odd_rows(spark, odd, none, odd_rows):
    rules = licenses.rules()
    assert 250 < len(rules)
    assert sort(licenses.scan(odd).drop("score", "n_detections").collect()) == sort((r[0], *brute.licenses(r[1], rules)) for r in odd_rows)
    assert licenses.scan(none).collect() == []
    texts = ["Licensed under the Apache License, Version 2.0.", "CC BY-NC-SA 4.0 and cc by", "GNU Lesser General Public License v2.1 or later",
             "all rights reserved All Rights Reserved", "mit license", "xcc by cc byx", "the MIT License " * 40, "SPDX-License-Identifier: GPL-3.0-or-later"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan(df).orderBy("doc_id").collect()
    assert sort(r[:7] for r in got) == sort((i, *brute.licenses(t, rules)) for i, t in enumerate(texts))
    assert [got[i].labels for i in (0, 2, 5)] == ["apache-2.0", "gpl,lgpl-2.1-or-later", ""] and got[6].n_detections == 40
    assert all(0 <= r.score <= 1 for r in got)


def test_mixing_on_odd_rows(odd, none, odd_rows):
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len(brute.SPACE_WORD.findall(r[1] or ""))
    want, taken = brute.shares(dict(sizes)), Counter()
    rows = mixing.mix(odd).collect()
    for r in rows:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r["size"]
    assert len(rows) == len(odd_rows) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert mixing.report(none).collect() == []
    mixed = mixing.mixed_texts(odd)
    words = Counter()
    for r in mixed.select("source", "text").collect():
        words[r.source] += len(brute.SPACE_WORD.findall(r.text))
    assert mixed.columns == odd.columns and all(words[s] == taken[s] for s in sizes)


def test_schedule_is_even(spark, checkpoints):
    table = spark.createDataFrame([("a", 0, 3e6), ("b", 1, 2e6), ("c", 2, 1e6)], "source string, rank long, target double")
    rows = mixing.schedule(table).orderBy("slot").collect()
    head = Counter(r.source for r in rows[:len(rows) // 2])
    assert abs(head["a"] / len(rows) * 2 - 0.5) < 0.02 and abs(head["c"] / len(rows) * 2 - 1 / 6) < 0.02


def test_url_filter(spark, checkpoints, none):
    link = '<html><head><LINK href="{}" rel="canonical"></head></html>'
    rows = [
        (1, "http://a.example.net/x", link.format("https://shop.com/de/1")), (2, "https://shop.com/de/1", None), (3, "http://b.net/y", link.format("/z")),
        (4, "http://b.net/z", '<meta http-equiv="Refresh" content="0; URL=http://A.example.net/x#top">'), (5, None, None), (6, "nothing", "<p>"),
        (7, "http://X.ORG?q#f", ""), (8, "http://example.org/en/12", ""), (9, "http://c.net/", link.format("http://shop.com/fr/1")),
        (10, "http://c.net", link.format("http://shop.com/de/9")), (11, "http://b.net/z?q=1", None), (12, "http://notexample.org/es/", None),
        (13, "http://m.example.org/es/a", None), (14, "http://d.net/a/b", link.format("c")), (15, "ftp://d.net/a/c", link.format("mailto:x@y")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("mine"))
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    verdicts = {k: r.verdict for k, r in got.items()}
    blocked = {k for k, v in verdicts.items() if v == "block"}
    assert blocked == {1, 2, 3, 4, 8, 13} and got[12].verdict == "allow" and got[12].rule == "org/"
    assert (got[7].host, got[7].path, got[5].host, got[6].path) == ("x.org", "", "", "") and got[7].rule is None
    assert got[9].component == got[10].component and got[14].component == got[15].component and got[11].component is None
    more = spark.createDataFrame([("http://b.net/z?q=1", "http://b.net/z"), (None, "x")], "from_url string, to_url string")
    assert {r.page_id for r in urlfilter.judge(df, more).where("verdict = 'block'").collect()} == blocked | {11}
    assert urlfilter.judge(df.where("false")).collect() == []


def test_components_against_brute_force(spark, checkpoints):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long")).collect()}
    part = brute.components(600, pairs)
    for node, component in got.items():
        assert component == min(i for i in range(600) if part[i] == part[node])
    assert set(got) == {x for p in pairs if p[0] != p[1] for x in p}


def test_chat_round_trip(spark, checkpoints):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", None), (1, 3, "assistant", "#<\\l\\b"), (2, 0, "user", "alone"),
            (None, 5, None, "x"), (3, None, "assistant", "a"), (3, 0, "ro: le\n", "b\n</turn>\n### user: c"), (3, 0, "ro: le\n", "b"), (4, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("mine"))
    got = {r.conv_id: r for r in chat.report(df).collect()}
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest() and r.n_turns == len(turns)
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    each = chat.examples(df).where("conv_id = 1").orderBy("example").collect()
    assert len(each) == 2 and each[1].text.startswith(each[0].text)
    assert each[1].text[each[1].loss_start:][:each[1].loss_length] == "\\h\\l\\bl\\bb"
    assert chat.report(df.where("false")).collect() == []


def test_bpe_on_odd_rows(spark, odd, none, odd_rows):
    tokens = bpe.load_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    encoded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, RANKS).select("doc_id", "text", "ids", "decoded", "kept").collect()
    assert sort((r.doc_id, r.text, r.kept) for r in back) == sort((r[0], r[1], "mine") for r in odd_rows)
    for r in back:
        assert r.ids == encoding.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_on_random_texts(monkeypatch):
    tokens = bpe.load_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice(" \n\t.a1é'sZ日 \x1c​!") for _ in range(rng.randint(0, 14))) for _ in range(800)] + ["=-" * 90, "x" * 300]
    monkeypatch.setattr(bpe, "STEP_ROWS", 3000)  # rounds that go on from where the last one stopped
    monkeypatch.setattr(bpe, "CACHE", 50)
    tokenizer = bpe.Tokenizer(tokens, public_tokenizers.PATTERN)
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        ids, starts = tokenizer.encode(part)
        assert bpe.written(ids, starts) == [",".join(map(str, encoding.encode_ordinary(t))) for t in part]
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [encoding.encode_ordinary(t) for t in part]
        assert tokenizer.decode(ids, starts) == [t.encode() for t in part]
    assert tokenizer.decode(*tokenizer.encode([])) == [] and tokenizer.decode(*tokenizer.encode(["", ""])) == [b"", b""]


def test_language_on_odd_rows(spark, odd, none, odd_rows):
    model = langid.train(odd)
    rows = langid.classify(odd, model).select("doc_id", "text", "lang_pred", "score", "kept").collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred != "und") == letters and 0 <= r.score <= 1 and r.kept == "mine"
    empty = langid.train(none)
    assert langid.classify(none, empty).collect() == [] and {r.lang_pred for r in langid.classify(odd, empty).collect()} == {"und"}
    assert langid.report(none).collect() == []


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 40])
def test_codewords_differ(n):
    codes = langid.codewords(n)
    assert codes.shape[0] == n and len(np.unique(codes, axis=0)) == n


def test_counts_ignore_where_texts_are_cut(monkeypatch):
    text = "Straße und weiter 日本 ".encode() * 50
    whole = langid.buckets(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert (langid.buckets(text) == whole).all() and whole.sum() == sum(len(text) + 3 - n for n in langid.GRAMS)


def test_top_k_on_odd_rows(spark, checkpoints, monkeypatch):
    rng = random.Random(8)
    vectors = [(i, [rng.choice([-0.5, 0.25, 0.3, 1.0]) for _ in range(6)]) for i in range(300)]
    odd = [(None, [1.0] * 6), (320, None), (340, []), (360, [1.0, None]), (380, [float("nan")]), (400, [float("inf")]), (420, [2.0]), (421, [1.0] * 9),
           (20, [0.5] * 6), (17, [0.25] * 6), (17, [0.25] * 6), (440, []), (440, []), (460, [4e6, 4e6]), (461, [4e6, -3e6])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("shard", F.lit("mine")).repartition(4)
    for name, value in (("QUERY_BLOCK", 5), ("SHARD", 40), ("FAN_IN", 2)):
        monkeypatch.setattr(topk, name, value)
    import math
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors + odd
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (q, own) in enumerate(whole):
        if q % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(own, v)), i) for n, (i, v) in enumerate(whole) if n != at)[:20]
            want += [(q, r + 1, i, -score) for r, (score, i) in enumerate(found)]
    assert sort(topk.report(df).collect()) == sort(want)
    assert topk.report(df.where("false")).collect() == []


def test_repeated_bytes_with_many_surroundings_in_a_batch(spark, checkpoints):
    rng = random.Random(6)
    shared = ["".join(rng.choice("abcdefghij ") for _ in range(420)) for _ in range(60)]
    rows = [(i, "".join(rng.choice(shared)[rng.randrange(150):] + f" {rng.random()} " for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sort(suffixdedup.report(df).collect()) == sort(brute.repeated_bytes(rows))
