"""Literal expectations of the scalar functions."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import difference
from newslake.functions import dates, fingerprint as fp, pages as pg, tagging as tg, text as tx, urls

C = F.col


@pytest.mark.parametrize("raw, want", [
    ("https://Example.com:443/path/?utm_source=x&b=2&a=1#frag", "https://example.com/path?a=1&b=2"),
    ("HTTP://Example.com:80", "http://example.com"), ("https://e.com/", "https://e.com/"), ("", ""),
    ("https://e.com/a//?fbclid=1", "https://e.com/a"), ("https://e.com/?q=a+b&x=%7E*", "https://e.com/?q=a+b&x=~%2A"),
    ("https://e.com:8443/x?b&a=", "https://e.com:8443/x?a=&b="),
])
def test_canonical_url(one, raw, want):
    assert one(urls.normalize_url("u"), u=raw) == want
    assert one(urls.url_hash("u"), u=raw) == hashlib.sha256(want.encode()).hexdigest()


def test_domain_and_candidates(one):
    assert one(urls.item_domain(None, "u"), u="https://News.Example.com/x") == "news.example.com"
    assert one(urls.item_domain(None, "u"), u="no address") == "unknown"
    assert one(urls.feed_candidates("u"), u="https://mosreg.ru/x") == []
    assert one(urls.feed_candidates("u"), u="https://e.com/x")[0] == "https://e.com/rss"
    assert one(urls.category_by_url("u"), u="https://riamo.ru/x") is None
    assert one(urls.category_by_url("u", broad=True), u="https://riamo.ru/x") == "moscow_region"


def naive_simhash(text):
    import re
    tokens = [t.lower() for t in re.findall("[A-Za-z0-9А-Яа-яЁё]+", text) if len(t) > 2]
    if not tokens:
        return None
    values = [int(hashlib.sha1(t.encode()).hexdigest()[:16], 16) for t in tokens]
    bits = sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))
    return bits - (1 << 64) if bits >> 63 else bits


def test_simhash_and_distance(one):
    a = "Moscow officials announced a new transport policy today."
    b = "Moscow officials announced a new transport policy this morning."
    left, right = one(fp.simhash("x", "t"), x=a, t="Transport update"), one(fp.simhash("x", "t"), x=b, t="Transport update")
    assert left == naive_simhash("Transport update " + a) and right == naive_simhash("Transport update " + b)
    assert one(fp.hamming("a", "b"), a=left, b=right) == bin((left ^ right) & (2**64 - 1)).count("1") <= 20
    assert one(fp.hamming("a", "b"), a=left, b=left) == 0
    assert one(fp.simhash("x"), x="a b") is None
    assert one(fp.simhash("x"), x="Мэр Москвы открыл новую станцию") == naive_simhash("Мэр Москвы открыл новую станцию")
    assert one(fp.hamming(F.lit(5).cast("long"), F.lit(-8).cast("long"))) == 63


def test_cache_key(one):
    key = one(fp.cache_key("summarize", "t", "b", "c", {"level": 3, "kind": "x"}), t=" Title ", b="Body", c="abc")
    assert key == hashlib.md5('summarize|abc|[["kind", "x"], ["level", 3]]'.encode()).hexdigest()
    plain = one(fp.cache_key("category", "t", "b"), t=" Title ", b=" Body")
    assert plain == hashlib.md5("category|title|body|[]".encode()).hexdigest()


def test_language_and_quality(one):
    assert one(tx.detect_language("x"), x="Привет мир") == "ru"
    assert one(tx.detect_language("x"), x="Hello мир") == "en"
    assert one(tx.detect_language("x"), x="") == "ru"
    assert one(tx.is_low_quality(tx.quality_score("x")), x="Короткий текст") is True
    good = " ".join(["Это хорошее длинное предложение о важных событиях."] * 30)
    assert one(tx.quality_score("x"), x=good) == pytest.approx(0.8)
    q = one(tx.quality_parts("x"), x="Подпишись на канал.\nСтрока\nСтрока")
    assert q["sentence_count"] == 2 and q["noise_ratio"] == 0.5 and q["repeat_ratio"] == pytest.approx(1 / 3)
    assert one(tx.quality_score("x"), x="") == 0.0


def test_truncation_and_compaction(one):
    assert one(tx.truncate_text("x", 10), x="one two three") == "one two..."
    assert one(tx.truncate_text("x", 5), x="abcdefgh") == "abcde..."
    assert one(tx.truncate_message("x", 10), x="ab cdefghijkl") == "ab cdefghi..."
    assert one(tx.compact_text("x", 10), x="abc") == "abc"
    out = one(tx.compact_text("x", 900), x="a" * 5000)
    assert len(out) <= 950 and "...\n" in out
    exact = one(tx.compact_text_exact("x", 900), x="a" * 5000)
    assert len(exact) <= 900 and exact.count("\n...\n") == 2


@pytest.mark.parametrize("n, want", [(59, "too_short"), (60, "ok"), (150, "ok"), (151, "too_long")])
def test_summary_validation(one, n, want):
    words = [f"w{i}" for i in range(n)]
    body = ". ".join(" ".join(words[i:i + 10]) for i in range(0, n, 10))
    assert one(tx.validate_summary("x"), x=body) == want


def test_summary_sentence_length(one):
    body = " ".join(["слово"] * 13) + ". " + ". ".join(["Это хорошая новость для граждан"] * 12) + "."
    assert one(tx.validate_summary("x"), x=body) == "sentence_too_long"
    for empty in ("", "   ", None):
        assert one(tx.validate_summary(F.lit(empty).cast("string"))) == "too_short"


def test_clean_and_leads(one):
    assert one(tx.clean_text("x"), x="see https://a.b/c or me@x.org, +7 (495) 123-45-67 now") == "see or now"
    assert one(tx.escape_markdown("x"), x="a_b*[c](d)~`") == r"a\_b\*\[c\]\(d\)\~\`"
    lead = "Власти города объявили о начале строительства новой линии метро"
    page = f"<html><script>var x = 1;</script><p>Меню</p><p>{lead} на севере столицы.</p></html>"
    assert lead in one(tx.lead_of_clean_text(pg.clean_html("h")), h=page)
    assert one(tx.choose_lead(F.array(F.lit("short"), F.lit("Читайте также: " + lead), F.lit(lead)))) == lead
    assert one(tx.is_noise_line(C("x")), x="Подписаться на канал и читать все новости каждый день утром") is True
    para = one(tx.first_paragraph("x"), x="Да. " + lead + ". Ещё одно вполне длинное предложение о том же событии. 22326 44.")
    assert para.startswith(lead) and para.endswith(".")


def test_message(one):
    out = one(tx.render_message("t", "x", "s", "u", F.lit("🌍 #Мир")), t="Политика: Важная новость о городе",
              x="Важная новость о городе. Подробности | позже/скоро и ещё немного текста", s="ria_ru", u="https://r.ru/a_b")
    assert out.splitlines()[0] == "Важная новость о городе" and "ria\\_ru" in out and out.endswith("🌍 #Мир")
    assert "позже скоро" in out and out.count("Важная новость") == 1
    assert one(tx.render_message("t", "x", "s", "u", F.lit("c")), t="Коротко", x="x", s="s", u="u") == ""


def test_html(one):
    page = "<p>a &amp; b &#1055;&#x440; &copy;</p><style>p{}</style><!-- no --><p>two</p>"
    assert [s for s in one(pg.page_text("h"), h=page).split("\n") if s] == ["a & b Пр ©", "two"]
    assert one(pg.clean_html("h"), h="plain &lt;text&gt;  here") == "plain <text> here"
    nav = "Главное Россия Мир Политика\nНастоящая строка текста\nмы в telegram"
    assert one(pg.drop_navigation_lines("x"), x=nav) == "Настоящая строка текста"
    line = "власти города объявили о начале строительства новой линии метро на севере"
    html = f"<nav>menu menu</nav><article><p>{line}</p><p>short</p><p>{line}, {line}</p></article>"
    assert one(pg.article_body("h"), h=html) == line
    body = '<div class="article__text"><p>' + "длинный абзац " * 5 + "</p></div>"
    assert one(pg.body_by_selectors("h", ["div.article__text"]), h=body) == ("длинный абзац " * 5).strip()
    links = one(pg.anchors("h"), h='<a class="x" href="/a"><b>One</b></a><a href="b">two</a>')
    assert [(r["href"], r["label"]) for r in links] == [("/a", "One"), ("b", "two")]


@pytest.mark.parametrize("raw, want", [
    ("2026-02-07T12:34:56+00:00", "2026-02-07 12:34:56"), ("2026-02-07T01:02:03Z", "2026-02-07 01:02:03"),
    ("Sat, 07 Feb 2026 12:00:00 +0300", "2026-02-07 09:00:00"), ("07 Feb 2026 12:00 GMT", "2026-02-07 12:00:00"),
    ("07.02.2026 10:30", "2026-02-07 10:30:00"), ("2026-02-07", "2026-02-07 00:00:00"), ("soon", None), ("", None),
    ("2026-02-07 10:30:15.250+0530", "2026-02-07 05:00:15"),
])
def test_dates(one, raw, want):
    assert one(F.date_format(dates.parse_datetime("x"), "yyyy-MM-dd HH:mm:ss"), x=raw) == want


@pytest.mark.parametrize("html, confidence", [
    ('<meta property="article:published_time" content="2026-02-07T12:34:56+00:00" />', "high"),
    ('<time datetime="2026-02-07T05:06:07"></time>', "medium"),
    ('<script type="application/ld+json">{"@type":"NewsArticle","datePublished":"2026-02-07T01:02:03Z"}</script>', "medium"),
    ("<p>nothing</p>", "low"),
])
def test_page_dates(one, html, confidence):
    info = one(pg.published_info("h", "u"), h=html, u="https://example.com/2026/02/07/test")
    assert info["confidence"] == confidence and info["published_date"] == "2026-02-07"


def pack(g0, g1, g2, g3, r0):
    return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("g0", "g1", "g2", "g3", "r0"), (g0, g1, g2, g3, r0))])


def test_tag_packs(one):
    tags = lambda p: one(tg.ordered_tags(tg.validate_pack(p)))
    assert tags(pack("#Мир", "#ЦФО", "#Москва", "#Москва", "#Общество")) == ["#Мир", "#Общество"]
    assert tags(pack("#Россия", "#ЦФО", "#Москва", "#Москва", "#Общество")).count("#Москва") == 1
    assert one(tg.validate_pack(pack("#Россия", "#ЦФО", "#Москва", "#Москва", "#Новости")))["r0"] == "#Общество"


def test_taxonomy(one):
    title, body = "В Тверской области обновили трассу", "В Тверской области завершили ремонт."
    geo = one(tg.geo_tags("t", "x"), t=title, x=body)
    assert (geo["g0"], geo["g1"], geo["g2"], geo["g3"]) == ("#Россия", "#ЦФО", "#ТверскаяОбласть", "#Тверь")
    assert one(tg.stored_tags("t", "x"), t=title, x=body)[0] == "#Мир"
    assert one(tg.stored_tags("t", "x"), t="Москва и РФ: " + title, x=body)[:2] == ["#Россия", "#ЦФО"]
    assert one(tg.english_tags(F.array(F.lit("#Россия"), F.lit("#ЦФО"), F.lit("#Спорт")))) == ["#Russia", "#ЦФО", "#Sports"]
    assert one(tg.tag_key("x"), x=" Орёл_город ") == "#орелгород"
    assert one(tg.classify("t", "x", "u"), t="Мэр Москвы Собянин", x="В Кремле", u="") == "moscow"
    assert one(tg.classify("t", "x", "u"), t="Трамп и Иран", x="иранский удар", u="") == "world"
    assert one(tg.classify("t", "x", "u"), t="x", x="y", u="https://a.ru/podmoskovie/") == "moscow_region"
    assert one(tg.classify("t", "x", "u"), t="Погода", x="дождь", u="") == "russia"


def test_keyword_groups_count_like_single_patterns(one):
    import re
    from newslake.functions import lexicon as lx
    body = "иранский посол в иране, лига чемпионов и премьер-лига; мэр москвы и москвы, полёт в польшу, вооружённый удар"
    for patterns in lx.CATEGORY_PATTERNS.values():
        want = sum(len(re.findall(p, body)) for p in patterns)
        assert one(tg.keyword_score("x", patterns), x=body) == want


def test_tag_lists(one):
    tags = one(tg.enforce_category_tag(F.array(F.lit("Россия"), F.lit("#a"), F.lit("#A")), F.lit("moscow")))
    assert tags == ["#Москва", "#a"]
    assert one(tg.parse_tag_json("x"), x='{"hashtags": ["a", "#b", "a", ""]}') == ["#a", "#b"]
    assert one(tg.parse_tag_json("x"), x="no json") == []
    assert one(tg.parse_pack_json("x"), x='{"g0": "#Луна"}') is None
    assert one(tg.parse_pack_json("x"), x='{"g0": "Россия"}')["g0"] == "#Россия"
    assert one(tg.top_up_tags(F.array(F.lit("#мир")), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), "x", "ru"), x="я" * 301) == ["#мир", "#a", "#b", "#c"]
    assert one(tg.category_line(F.lit("world"), F.lit("#x"))) == "🌍 #Мир #x"


def test_queries_of_page_text_keep_open_entities(spark, one, tmp_path):
    """A page cut inside an entity: the library reads a name without semicolon, the two queries leave it as their SQL does."""
    html = "<html><title>cut &amp;&amp</title><article><p>body &amp; text &copy;</p></article></html>"
    assert one(pg.page_text("h"), h=html).split("\n")[2] == "cut &&" and one(pg.page_text("h", bare=False), h=html).split("\n")[2] == "cut &&amp"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("f10_clean_html", "f11_navigation_lines"):
        assert difference(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("pattern, word", [
    ("Подписаться\\s+на\\s+канал", "подписаться"), ("айфон[ыа]?", "айфон"), ("(Мир|Россия):", ""), ("РБК|ТАСС", ""), ("(?s:Лента новостей.*?Все)", "новостей"),
    ("(Фото)?: ТАСС", "тасс"), ("новости?", "новост"), ("ал*ба", "ба"), ("\\u0430бв", ""), ("18\\+\\s*RT", "rt"), ("\\d{2}:\\d{2}", ""), ("Instagram", "nstagram"),
])
def test_sure_word(pattern, word):
    assert pg.sure_word(pattern) == word


def test_phrases_go_one_after_the_other(one):
    """Removals in any letter case, also where one makes the next match; patterns that cannot match are not run."""
    patterns = ["абв", "гд+е?", "(?:ж|з)и", "KEK"]
    assert one(pg.without_phrases("t", patterns), t="габвД АБВx ЖИ ᲀ Kek кот") == "x  ᲀ  кот".replace("x", " x", 1)
    assert one(pg.without_phrases("t", ["вода"]), t="ᲀода") == "" and one(pg.without_phrases("t", []), t="вода") == "вода"
    assert sum(not pg.sure_word(p) for p in pg.lx.JUNK_PATTERNS) < 15


def test_keyword_counts_are_those_of_single_patterns(spark):
    """Letters looked for first change no count: texts of keywords, of other words, without any letter of a keyword, and empty ones."""
    import random
    import re

    from newslake.functions import lexicon as lx, tagging as tg

    rng = random.Random(4)
    hits = ["москва", "столичный", "мо", "мособласть", "иран", "иранский", "порту", "сша", "лига 1", "вооружен", "химки", "кремля", "смо", "амо", "полёт"]
    texts = ["", "the lower river", "—", "мо", "xмо мо-мо мо_"] + [" ".join(rng.choice(hits + ["the", "и", "xx-"]) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (*lx.CATEGORY_PATTERNS.values(), [r"\\bthe\\b|\\bи\\b", r"xx"], [r"\\bs?мо", r"\\bthe"]):
        patterns = [p.replace("\\\\b", "\\b") for p in patterns]
        got = [r.n for r in df.select(tg.keyword_score("t", patterns).alias("n")).collect()]
        assert got == [sum(len(re.findall(p, t)) for p in patterns) for t in texts]
    assert tg.alternation([r"\bмо\b", r"\bсша\b"]) == r"(?=[мс])\b(?:(?:мо\b)|(?:сша\b))"
    assert tg.alternation([r"\bмо\b", r"сша"]) == r"(?:\bмо\b)|(?:сша)"
