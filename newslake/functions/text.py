"""Text measures, cleaning, truncation, lead selection and message rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslake.functions import lexicon as lx
from newslake.functions.base import (
    ColumnOrName, any_of, col, contains_any, count_chars, hits, let, lines, prefix, rfind, rstrip, squeeze,
    strip, text, word_count, words,
)

_SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+"
_CYRILLIC = "А-Яа-яЁё"


# ---------------------------------------------------------------- measures
def detect_language(body: ColumnOrName, title: ColumnOrName | None = None) -> Column:
    """``en`` when Latin letters outnumber Cyrillic ones by a fifth, else ``ru``."""
    sample = F.lower(text(body) if title is None else F.concat_ws(" ", text(title), text(body)))
    return F.when(count_chars(sample, "a-z") > count_chars(sample, "а-яё") * 1.2, "en").otherwise("ru")


def quality_parts(body: ColumnOrName, phrases: list[str] | None = None) -> Column:
    """Struct of length, sentence_count, noise_ratio, repeat_ratio and the score in 0..1."""
    return let(strip(text(body)), lambda raw: _quality(raw, phrases or lx.NOISE_PHRASES))


def _quality(raw: Column, phrases: list[str]) -> Column:
    length = F.length(raw)
    sentences = F.when(raw == "", 0).otherwise(F.regexp_count(raw, F.lit(r"(?U)[.!?]\s+")) + 1)
    noise = F.least(F.lit(1.0), hits(F.lower(raw), phrases) / F.greatest(F.lit(1), sentences))
    repeat = let(lines(raw), lambda ls: F.when(
        F.size(ls) > 0, F.lit(1.0) - F.size(F.array_distinct(ls)) / F.size(ls)).otherwise(F.lit(0.0)))
    parts = F.struct(length.alias("length"), sentences.alias("sentence_count"), noise.alias("noise_ratio"), repeat.alias("repeat_ratio"))
    return let(parts, _scored)


def _scored(p: Column) -> Column:
    score = (
        F.least(F.lit(1.0), p["length"] / F.lit(900.0)) * 0.5
        + F.least(F.lit(1.0), p["sentence_count"] / F.lit(5.0)) * 0.3
        - (p["noise_ratio"] * 0.1 + p["repeat_ratio"] * 0.1)
    )
    score = F.when(p["length"] == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return F.struct(*[p[c].alias(c) for c in ("length", "sentence_count", "noise_ratio", "repeat_ratio")], score.alias("score"))


def quality_score(body: ColumnOrName, phrases: list[str] | None = None) -> Column:
    return quality_parts(body, phrases)["score"]


def is_low_quality(score: ColumnOrName, threshold: float | Column = 0.55) -> Column:
    return col(score) < threshold


def validate_summary(body: ColumnOrName, low: int = 60, high: int = 150, per_sentence: int = 12) -> Column:
    """ok / too_short / too_long / sentence_too_long."""
    raw = text(body)
    n = word_count(raw)
    long_sentence = F.exists(F.split(raw, r"\."), lambda s: word_count(s) > per_sentence)
    return (
        F.when(n < low, "too_short").when(n > high, "too_long")
        .when(long_sentence, "sentence_too_long").otherwise("ok")
    )


# -------------------------------------------------------------- truncation
def truncate_text(c: ColumnOrName, limit: int = 500) -> Column:
    """Cut at the last space inside the limit and add dots."""

    def shorten(cut: Column) -> Column:
        space = rfind(cut, " ")
        return F.concat(F.when(space > 0, prefix(cut, space)).otherwise(cut), F.lit("..."))

    return let(col(c), lambda full: F.when(F.length(full) <= limit, full).otherwise(let(prefix(full, limit), shorten)))


def truncate_message(c: ColumnOrName, limit: int = 1000) -> Column:
    """Hard limit; the word boundary is used only if it lies in the second half."""

    def shorten(cut: Column) -> Column:
        space = rfind(cut, " ")
        return F.concat(rstrip(F.when(space > limit // 2, prefix(cut, space)).otherwise(cut)), F.lit("..."))

    return let(col(c), lambda full: F.when(F.length(full) <= limit, full).otherwise(let(prefix(full, limit), shorten)))


def compact_text(c: ColumnOrName, limit: int, whole: bool = True) -> Column:
    """Head … middle … tail of a cleaned text within a budget, then cut at a word."""
    return let(squeeze(c), lambda cleaned: _compact(cleaned, limit, whole))


def _compact(cleaned: Column, limit: int, whole: bool) -> Column:
    n = F.length(cleaned)
    chunk = max(1, limit // 3)
    joined = F.concat_ws(
        "\n...\n", prefix(cleaned, chunk),
        F.substring(cleaned, F.greatest(F.lit(0), F.floor(n / 2).cast("int") - chunk // 2) + 1, F.lit(chunk)),
        F.substring(cleaned, n - chunk + 1, F.lit(chunk)),
    )
    short = truncate_text(joined, limit) if whole else truncate_text(cleaned, limit)
    return F.when(n <= limit, cleaned).otherwise(short)


def compact_text_exact(c: ColumnOrName, limit: int) -> Column:
    """Head … middle … tail that fits the budget without a second cut.

    The chunk size that a shrink loop would reach is known in advance: three
    chunks and two separators of five characters must fit the limit.
    """
    raw = text(c)
    n = F.length(raw)
    chunk = (limit - 10) // 3
    if chunk >= 1:
        joined = F.concat_ws(
            "\n...\n", prefix(raw, chunk),
            F.substring(raw, F.greatest(F.lit(0), F.floor(n / 2).cast("int") - chunk // 2) + 1, F.lit(chunk)),
            F.substring(raw, n - chunk + 1, F.lit(chunk)),
        )
    else:
        joined = truncate_text(raw, limit - 3) if limit > 3 else F.lit("..."[: max(0, limit)])
    return F.when(n <= limit, raw).otherwise(joined)


# ---------------------------------------------------------------- cleaning
def clean_text(c: ColumnOrName) -> Column:
    """Remove addresses, e-mails and phones, collapse spaces."""
    out = text(c)
    for pattern in (lx.URL_PATTERN, lx.EMAIL_PATTERN, lx.PHONE_PATTERN):
        out = F.regexp_replace(out, "(?U)" + pattern, "")
    return squeeze(out)


def escape_markdown(c: ColumnOrName) -> Column:
    return F.regexp_replace(col(c), r"[_*\[\]()~`]", r"\\$0")


def digest_text(c: ColumnOrName) -> Column:
    """Text for a reader's digest: no emoji, service labels or extra spaces."""
    out = F.regexp_replace(text(c), lx.DIGEST_EMOJI_PATTERN, "")
    out = F.regexp_replace(out, lx.DIGEST_SYMBOL_PATTERN, "")
    return squeeze(F.regexp_replace(out, f"(?iu){lx.DIGEST_LABEL_PATTERN}", ""))


def normalized_title(c: ColumnOrName) -> Column:
    """Lower case, punctuation removed (inner spaces kept)."""
    return F.regexp_replace(F.lower(text(c)), r"(?U)[^\w\s]", "")


def title_words(c: ColumnOrName, stopwords: list[str] | None = None) -> Column:
    """Distinct content words of a title: longer than two letters, no stop words."""
    stop = stopwords if stopwords is not None else lx.TITLE_STOPWORDS
    return F.array_distinct(F.filter(words(normalized_title(c)), lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def is_valid_title(c: ColumnOrName, noise: list[str] | None = None) -> Column:
    low = F.lower(text(c))
    return (low != "") & ~contains_any(low, noise or lx.TITLE_NOISE)


# ------------------------------------------------------------------- leads
def first_paragraph(c: ColumnOrName, limit: int = 250) -> Column:
    """Leading good sentences within a length budget, else the cut text."""
    body = strip(text(c))
    body = F.regexp_replace(body, r"(?U)\s*[а-яА-Я]+:\s*[а-яА-Я\s\-]*$", "")
    body = F.regexp_replace(
        body, r"(?iu)(Фото|Источник|Смотрите также|Читайте также|Ранее сообщалось|Подробнее):\s*.*$", ""
    )
    letters = r"[а-яА-Яa-zA-Z]+"
    good = F.filter(
        F.transform(F.split(body, "[.!?]+"), strip),
        lambda s: F.length(s).between(20, 500)
        & (F.regexp_count(s, F.lit(letters)) >= 5)
        & (F.regexp_count(s, F.lit(r"\d+")) <= F.regexp_count(s, F.lit(letters)) * 0.3)
        & ~F.endswith(s, F.lit(":")),
    )
    start = F.struct(
        F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full")
    )

    def take(state: Column, s: Column) -> Column:
        full = state["full"] | (state["used"] + F.length(s) > limit)
        return F.struct(
            F.when(full, state["kept"]).otherwise(F.concat(state["kept"], F.array(s))).alias("kept"),
            F.when(full, state["used"]).otherwise(state["used"] + F.length(s) + 1).alias("used"),
            full.alias("full"),
        )

    joined = F.aggregate(
        good, start, take, lambda st: F.when(F.size(st["kept"]) > 0, F.concat(F.array_join(st["kept"], ". "), F.lit(".")))
    )
    return F.when(text(c) == "", F.lit("")).otherwise(truncate_text(F.coalesce(joined, body), limit))


def is_noise_line(line: Column, min_len: int = 50, phrases: list[str] | None = None) -> Column:
    """A line that is too short, service text, mostly links or contacts."""
    opener = f"^(?:{any_of(lx.LEAD_LINE_OPENERS)})"
    return (
        (F.length(line) < min_len)
        | let(F.lower(line), lambda low: contains_any(low, phrases or lx.LEAD_STOP_PHRASES) | low.rlike(opener))
        | (F.regexp_count(line, F.lit("(?U)" + lx.URL_PATTERN)) > 2)
        | line.rlike("(?U)" + lx.EMAIL_PATTERN)
        | (F.regexp_count(line, F.lit(lx.PHONE_PATTERN)) > 1)
        | ((F.length(line) < 60) & line.rlike(rf"[^\x00-\x7F{_CYRILLIC} ]"))
    )


def lead_candidates(c: ColumnOrName, min_len: int = 50, phrases: list[str] | None = None) -> Column:
    """Cleaned paragraphs that could open an item."""
    stop = phrases or lx.LEAD_STOP_PHRASES
    cleaned = F.transform(F.filter(lines(c), lambda ln: ~is_noise_line(ln, min_len, stop)), clean_text)
    return F.filter(
        cleaned,
        lambda ln: (F.length(ln) >= min_len) & ~let(F.lower(ln), lambda low: contains_any(low, stop)) & ln.rlike("(?iu)[а-яёa-z0-9]"),
    )


def choose_lead(candidates: Column, limit: int = 800, phrases: list[str] | None = None) -> Column:
    """First acceptable candidate, cut to the limit; empty if none."""
    stop = phrases or lx.LEAD_STOP_PHRASES
    good = F.filter(
        F.transform(candidates, strip),
        lambda ln: (F.length(ln) >= 50)
        & ~let(F.lower(ln), lambda low: contains_any(low, stop))
        & (F.length(ln) - count_chars(ln, rf"\x00-\x7F{_CYRILLIC}") <= F.length(ln) * 0.1),
    )
    return truncate_text(F.coalesce(F.try_element_at(good, F.lit(1)), F.lit("")), limit)


def sentences(c: ColumnOrName) -> Column:
    return F.filter(F.transform(F.split(col(c), _SENTENCE_BREAK), strip), lambda s: s != "")


def first_good_sentence(c: ColumnOrName, limit: int = 800, phrases: list[str] | None = None) -> Column:
    """First long, clean and mostly Cyrillic sentence; empty if none."""
    stop = phrases or lx.LEAD_STOP_PHRASES
    return let(clean_text(c), lambda cleaned: _good_sentence(cleaned, limit, stop))


def _good_sentence(cleaned: Column, limit: int, stop: list[str]) -> Column:
    good = F.filter(
        sentences(cleaned),
        lambda s: (F.length(s) >= 50)
        & ~let(F.lower(s), lambda low: contains_any(low, stop))
        & (count_chars(s, f"{_CYRILLIC} ") >= F.length(s) * 0.6),
    )
    found = truncate_text(F.coalesce(F.try_element_at(good, F.lit(1)), F.lit("")), limit)
    return F.when(F.length(cleaned) < 50, F.lit("")).otherwise(found)


def lead_of_clean_text(cleaned: ColumnOrName, limit: int = 800, emergency: bool = True,
                       phrases: list[str] | None = None) -> Column:
    """Lead of an already cleaned page or feed text, with its fallbacks."""
    return let(col(cleaned), lambda body: _lead(body, limit, emergency, phrases))


def _lead(body: Column, limit: int, emergency: bool, phrases: list[str] | None) -> Column:
    picks = [choose_lead(lead_candidates(body, phrases=phrases), limit, phrases), first_good_sentence(body, limit, phrases)]
    if emergency:
        usable = F.filter(
            sentences(body),
            lambda s: (F.length(s) >= 80) & ~let(F.lower(s), lambda low: contains_any(low, lx.LEAD_EMERGENCY_STOP)),
        )
        picks.append(truncate_text(F.coalesce(F.try_element_at(usable, F.lit(1)), F.lit("")), limit))
        points = [
            F.when(pos > 0, pos - 1)
            for pos in (F.locate(". ", body, 81), F.locate(". ", body, 101), F.locate(" ", body, 101))
        ]
        stop_at = F.coalesce(F.least(*points), F.lit(120))
        picks.append(F.when(F.length(body) >= 100, strip(prefix(body, stop_at))).otherwise(F.lit("")))
    found = F.coalesce(*[let(p, lambda x: F.when(x != "", x)) for p in picks], F.lit(""))
    return F.when(F.length(body) < 50, F.lit("")).otherwise(found)


# ---------------------------------------------------------------- messages
def render_message(title: ColumnOrName, body: ColumnOrName, source: ColumnOrName, url: ColumnOrName,
                   category_line: ColumnOrName, noise: list[str] | None = None) -> Column:
    """Message text of an item; empty when the title is too short or looks like page chrome."""
    head = text(title)
    for pattern in lx.TITLE_PREFIX_PATTERNS:
        head = F.regexp_replace(head, f"(?iu){pattern}", "")
    parts = F.struct(
        head.alias("head"), squeeze(F.regexp_replace(text(body), "<[^>]+>", "")).alias("body"), text(source).alias("source"),
        text(url).alias("url"), text(category_line).alias("line"),
    )
    return let(parts, lambda p: F.when(_bad_head(p["head"], noise or lx.MESSAGE_TITLE_NOISE), F.lit("")).otherwise(
        truncate_message(_message(p), 1000)))


def _bad_head(head: Column, noise: list[str]) -> Column:
    return (F.length(head) < 15) | F.startswith(head, F.lit("/")) | contains_any(F.lower(head), noise)


def _message(p: Column) -> Column:
    plain = lambda c: F.translate(c, "/|\\", " ")  # noqa: E731  slash to space, bar and backslash away
    fold = lambda c: squeeze(F.lower(c))
    head = plain(p["head"])

    def without_head(body: Column) -> Column:
        rest = strip(F.ltrim(strip(F.substring(body, F.length(head) + 1, F.length(body))), F.lit("|:.-")))
        return F.when(F.startswith(fold(body), fold(head)), rest).otherwise(body)

    def preview(body: Column) -> Column:
        start = strip(prefix(body, 300))
        return escape_markdown(F.when(F.length(start) < 30, truncate_text(body, 200)).otherwise(start))

    relayed = F.startswith(p["source"], F.lit("@")) | F.contains(F.lower(p["url"]), F.lit("rsshub"))

    def laid_out(paragraph: Column) -> Column:
        titled = F.concat(
            escape_markdown(head), F.lit("\n"),
            F.when(paragraph != "", F.concat(F.lit("\n"), strip(paragraph), F.lit("\n"))).otherwise(F.lit("")),
        )
        return F.concat(
            F.when(relayed, F.concat(paragraph, F.lit("\n"))).otherwise(titled),
            F.lit("\nИсточник: "), escape_markdown(p["source"]), F.lit("\n"), escape_markdown(p["url"]), F.lit("\n\n"), p["line"],
        )

    return let(preview(let(plain(p["body"]), without_head)), laid_out)
