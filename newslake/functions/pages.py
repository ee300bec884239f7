"""Landed HTML pages and feed documents → text, links, cards, dates.

Regular expressions stand in for a DOM: each works on the whole page in one
narrow stage.  Pages with broken nesting can differ from a DOM parser's view.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslake.functions import lexicon as lx
from newslake.functions.base import (
    ColumnOrName, any_of, col, contains_any, hits, let, lines, prefix, squeeze, strip, strings, text, words,
)
from newslake.functions.dates import date_text, parse_datetime, time_text
from newslake.functions.urls import url_date

_TAG = r"<[^>]+>"
_JSONLD = "array<struct<`@type`:string,datePublished:string,dateModified:string>>"


def _drop_element(html: Column, *names: str) -> Column:
    for name in names:
        html = F.regexp_replace(html, rf"(?is)<{name}\b[^>]*>.*?</{name}>", "")
    return html


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numeric_entities(c: Column) -> Column:
    """Replace &#NN; and &#xHH; by splitting at the marker and translating each piece's head."""

    def piece(p: Column, i: Column) -> Column:
        dec = F.regexp_extract(p, r"^(\d{1,7});?", 1)
        hexa = F.regexp_extract(p, r"^[xX]([0-9A-Fa-f]{1,6});?", 1)
        number = F.when(dec != "", dec.try_cast("long")).when(hexa != "", F.conv(hexa, 16, 10).cast("long"))
        ok = number.between(1, 1114111) & ~number.between(55296, 57343)
        rest = F.regexp_replace(p, r"^(?:\d{1,7}|[xX][0-9A-Fa-f]{1,6});?", "")
        return F.when(i == 0, p).when(ok, F.concat(_code_point(number), rest)).otherwise(F.concat(F.lit("&#"), p))

    return F.when(F.contains(c, F.lit("&#")), F.array_join(F.transform(F.split(c, "&#"), piece), "")).otherwise(c)


def unescape(c: ColumnOrName, bare: bool = True) -> Column:
    """Character entities to characters: numeric ones and all names of HTML 5; with ``bare`` also names that count without a semicolon."""
    return let(col(c), lambda raw: F.when(F.contains(raw, F.lit("&")), _named_entities(_numeric_entities(raw), bare)).otherwise(raw))


#: Names that count without a semicolon, the longest first.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _named_entities(c: Column, bare_names: bool) -> Column:
    """Replace &name; by splitting at the marker and looking up each piece's head."""
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def piece(p: Column, i: Column) -> Column:
        name = F.regexp_extract(p, r"^[A-Za-z][A-Za-z0-9]{0,30};", 0)
        found = lambda key: F.concat(F.try_element_at(table, key), F.substring(p, F.length(key) + 1, F.length(p)))
        bare = [found(F.regexp_extract(p, "^(?:" + "|".join(_BARE) + ")", 0))] if bare_names else []
        return F.when(i == 0, p).otherwise(F.coalesce(found(name), *bare, F.concat(F.lit("&"), p)))

    return F.array_join(F.transform(F.split(c, "&"), piece), "")


def page_text(html: ColumnOrName, bare: bool = True) -> Column:
    """Text nodes of a page, one per line, without scripts, styles and comments; ``bare`` as in ``unescape``."""
    body = F.regexp_replace(text(html), r"(?s)<!--.*?-->", "")
    body = _drop_element(body, "script", "style", "noscript")
    return unescape(unescape(F.regexp_replace(body, _TAG, "\n"), bare), bare)


def drop_navigation_lines(c: ColumnOrName, keywords: list[str] | None = None, domains: list[str] | None = None,
                          patterns: list[str] | None = None) -> Column:
    """Remove lines that are menus, footers or social blocks."""
    words_list = strings(keywords or lx.NAVIGATION_KEYWORDS)
    rx = "(?iu)" + "|".join(f"(?:{p})" for p in (patterns or lx.NAVIGATION_PATTERNS))

    def menu(tokens: Column) -> Column:
        nav = F.size(F.filter(tokens, lambda t: F.array_contains(words_list, t)))
        return (F.size(tokens) > 0) & (nav >= F.greatest(F.lit(3), F.floor(F.size(tokens) * 0.7).cast("int")))

    def dropped(low: Column) -> Column:
        tokens = F.regexp_extract_all(low, F.lit("[а-яa-z0-9]+"), F.lit(0))
        return low.rlike(rx) | contains_any(low, domains or lx.SOCIAL_DOMAINS) | let(tokens, menu)

    return F.array_join(F.filter(lines(c), lambda line: ~let(F.lower(line), dropped)), "\n")


def sure_word(pattern: str) -> str:
    """Longest run of letters that every match of a pattern holds, in lower case; empty if none is sure.

    The letter i ends a run, as it changes its length with the case of a dotted one.
    """
    if re.search(r"\\[xupPQNck0]", pattern):
        return ""
    flat = re.sub(r"\[[^\]]*\]", "\0", re.sub(r"\\.", " ", pattern))  # escapes, then classes
    flat = re.sub(r"\(\?s:([^()|]*)\)(?![?*{])", r"\1", flat)
    while (less := re.sub(r"\([^()]*\)", "\0", flat)) != flat:       # groups from the inside out
        flat = less
    runs = re.findall("[a-hj-zа-яё]+", re.sub(r".[?*{]", " ", flat).lower())
    return "" if re.search(r"[|()\[\]]", flat) else max(runs, key=len, default="")


def without_phrases(c: ColumnOrName, patterns: list[str]) -> Column:
    """Text without the matches of the patterns, one after the other, as a removal can make or break the next match.

    A pattern runs only over a text that holds its sure word; most texts hold few of these words.
    """
    # letters that (?iu) takes for others although lower case keeps them apart
    folded = lambda kept: F.struct(kept.alias("kept"), F.translate(F.lower(kept), "ᲀᲁᲂᲃᲄᲅᲆſ", "вдосттъs").alias("low"))
    steps = F.array(*[F.struct(F.lit(f"(?iuU){p}").alias("pattern"), F.lit(sure_word(p)).alias("word")) for p in patterns])

    def step(state: Column, s: Column) -> Column:
        cut = let(F.regexp_replace(state["kept"], s["pattern"], F.lit("")), folded)
        return F.when(F.contains(state["low"], s["word"]), cut).otherwise(state)

    return F.aggregate(steps, let(col(c), folded), step, lambda state: state["kept"]) if patterns else col(c)


def clean_html(html: ColumnOrName, junk: list[str] | None = None, keywords: list[str] | None = None, bare: bool = True) -> Column:
    """Readable text of a page: tags, junk phrases and navigation lines removed, one line; ``bare`` as in ``unescape``."""
    raw = text(html)
    body = without_phrases(page_text(raw, bare), junk if junk is not None else lx.JUNK_PATTERNS)
    body = squeeze(drop_navigation_lines(body, keywords))
    body = strip(F.translate(body, "/\\", "  "))
    return F.when(raw.rlike("[<>]"), body).otherwise(squeeze(unescape(raw, bare)))


def article_body(html: ColumnOrName, limit: int | None = None, nav: list[str] | None = None) -> Column:
    """Main text of an article page: good lines of the main block, the first three of them.

    Null when less than 50 characters survive.  ``limit`` cuts the result for
    consumers with a size budget.
    """
    body = _drop_element(text(html), "script", "style", "noscript", "nav", "header", "footer", "aside")
    body = F.regexp_replace(body, lx.ARTICLE_SIDE_BLOCK, "")
    block = lx.ARTICLE_MAIN_BLOCK
    body = let(body, lambda b: F.when(b.rlike(block), F.regexp_extract(b, block, 1)).otherwise(b))
    body = unescape(F.regexp_replace(body, _TAG, "\n"))

    def keep(line: Column) -> Column:
        low = F.lower(line)
        w = words(line)
        capitals = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
        head = F.array_join(F.slice(words(low), 1, 4), " ")
        repeated = (F.size(w) >= 4) & F.contains(F.substring(low, F.length(head) + 1, F.length(low)), head)
        listing = (F.size(w) > 5) & (capitals > F.size(w) * 0.7)
        bait = (F.length(line) < 150) & (hits(low, lx.CLICKBAIT_MARKS) >= 2)
        return (F.length(line) >= 40) & ~listing & ~contains_any(low, nav or lx.ARTICLE_NAV_PHRASES) & ~repeated & ~bait

    kept = F.array_join(F.slice(F.filter(lines(body), keep), 1, 3), "\n")
    kept = let(kept, lambda k: F.when(F.length(k) >= 50, k))
    return kept if limit is None else prefix(kept, limit)


def selector_pattern(selector: str) -> str:
    """``tag.class`` / ``tag[attr='v']`` / ``tag`` → pattern of the block that starts there."""
    tag, _, cls = selector.partition(".")
    attr = ""
    if "[" in tag:
        tag, _, cond = tag.partition("[")
        name, _, value = cond.rstrip("]").partition("=")
        attr = rf"""(?=[^>]*\b{name}\s*=\s*["']{value.strip("'")}["'])"""
    if cls:
        attr = rf"""(?=[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?{cls}(?:\s[^"']*)?["'])"""
    end = "</article>" if tag == "article" else "</article>|</main>|<footer"
    return rf"(?is)<{tag}\b{attr}[^>]*>(.*?)(?:{end}|\z)"


def body_by_selectors(html: ColumnOrName, selectors: list[str]) -> Column:
    """First selector that yields paragraphs over 40 characters; up to six of them."""

    def paragraphs(selector: str) -> Column:
        block = F.regexp_extract(text(html), selector_pattern(selector), 1)
        raw = F.regexp_extract_all(block, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
        clean = F.transform(raw, lambda p: squeeze(unescape(F.regexp_replace(p, _TAG, " "))))
        good = F.slice(F.filter(clean, lambda p: F.length(p) > 40), 1, 6)
        return F.when(F.size(good) > 0, F.array_join(good, "\n"))

    return F.coalesce(*[paragraphs(s) for s in selectors])


def anchors(html: ColumnOrName) -> Column:
    """Array of (href, label) of all links of a page."""
    raw = F.regexp_extract_all(text(html), F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    return F.transform(
        raw,
        lambda a: F.struct(
            unescape(F.regexp_extract(a, r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""", 1)).alias("href"),
            strip(unescape(F.regexp_replace(a, _TAG, ""))).alias("label"),
        ),
    )


def cards(html: ColumnOrName) -> Column:
    """Array of (title, href, summary) of the article-like blocks of a page."""
    blocks = F.regexp_extract_all(
        text(html),
        F.lit(r"""(?is)(<(?:article\b|div\b[^>]*class\s*=\s*["'][^"']*(?:news|article|item|post|story)[^"']*["'])[^>]*>.*?</(?:article|div)>)"""),
        F.lit(1),
    )
    inner = lambda b, tag: strip(
        unescape(F.regexp_replace(F.regexp_extract(b, rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})>", 1), _TAG, ""))
    )
    return F.transform(
        blocks,
        lambda b: F.struct(
            inner(b, "h1|h2|h3|h4").alias("title"),
            F.regexp_extract(b, r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""", 1).alias("href"),
            inner(b, "p|span").alias("summary"),
        ),
    )


def published_info(html: ColumnOrName, url: ColumnOrName, zone: str = "UTC") -> Column:
    """Publication date of a page: meta tags, then <time>, then JSON-LD, then the URL."""
    page = text(html)

    def found(ts: Column, confidence: str, label: str) -> Column:
        return let(ts, lambda at: F.when(
            at.isNotNull(),
            F.struct(
                at.alias("published_at"), date_text(at, zone).alias("published_date"),
                time_text(at, zone).alias("published_time"), F.lit(confidence).alias("confidence"),
                F.lit(label).alias("label"),
            ),
        ))

    steps = []
    for attr, value, label, confidence in lx.META_DATE_TAGS:
        content = F.regexp_extract(
            page,
            rf"""(?is)<meta\b(?=[^>]*\b{attr}\s*=\s*["']{value}["'])(?=[^>]*\bcontent\s*=\s*["']([^"']*)["'])[^>]*>""", 1,
        )
        steps.append(found(parse_datetime(content, zone), confidence, label))
    stamp = F.regexp_extract(page, r"""(?is)<time\b[^>]*?\bdatetime\s*=\s*["']([^"']*)["']""", 1)
    steps.append(found(parse_datetime(stamp, zone), "medium", "time:datetime"))
    scripts = F.regexp_extract_all(
        page, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1)
    )
    nodes = F.filter(
        F.flatten(F.transform(scripts, lambda s: F.coalesce(F.from_json(s, _JSONLD), F.array().cast(_JSONLD)))),
        lambda n: n["@type"].isin(lx.JSONLD_TYPES),
    )
    stamps = F.filter(
        F.transform(
            nodes,
            lambda n: parse_datetime(F.when(text(n["datePublished"]) != "", n["datePublished"]).otherwise(n["dateModified"]), zone),
        ),
        lambda t: t.isNotNull(),
    )
    steps.append(found(F.try_element_at(stamps, F.lit(1)), "medium", "jsonld:datePublished"))
    day = F.when(page != "", url_date(url))
    by_url = F.struct(
        F.lit(None).cast("timestamp").alias("published_at"), F.date_format(day, "yyyy-MM-dd").alias("published_date"),
        F.lit(None).cast("string").alias("published_time"),
        F.when(day.isNotNull(), "low").otherwise("none").alias("confidence"),
        F.when(day.isNotNull(), "url:date").alias("label"),
    )
    return F.coalesce(*steps, by_url)


def matches_any(c: ColumnOrName, literals: list[str]) -> Column:
    return col(c).rlike(any_of(literals))
