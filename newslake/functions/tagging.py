"""Categories, taxonomy tags, tag lists and tag candidates."""

from __future__ import annotations

from dataclasses import dataclass, field
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslake.functions import lexicon as lx
from newslake.functions.base import (
    ColumnOrName, blank_to_null, col, contains_any, keep_first, let, lookup, squeeze, strip, strings, text,
)
from newslake.functions.urls import category_by_url


@dataclass(frozen=True)
class Taxonomy:
    """The word lists the taggers work with; the defaults are the fixed values."""

    category_patterns: dict[str, list[str]] = field(default_factory=lambda: lx.CATEGORY_PATTERNS)
    region_aliases: dict[str, list[str]] = field(default_factory=lambda: lx.REGION_ALIASES)
    city_aliases: dict[str, list[str]] = field(default_factory=lambda: lx.CITY_ALIASES)
    city_regions: dict[str, str] = field(default_factory=lambda: lx.CITY_REGIONS)
    region_capitals: dict[str, str] = field(default_factory=lambda: lx.REGION_CAPITALS)
    world_markers: list[str] = field(default_factory=lambda: lx.WORLD_MARKERS)
    russia_markers: list[str] = field(default_factory=lambda: lx.RUSSIA_MARKERS)
    rubric_keywords: dict[str, list[str]] = field(default_factory=lambda: lx.RUBRIC_KEYWORDS)
    rubric_words: dict[str, list[str]] = field(default_factory=lambda: lx.RUBRIC_WORDS)
    russia_strong: str = lx.RUSSIA_STRONG
    global_tech: str = lx.GLOBAL_TECH
    capital_tag: str = "#Москва"


DEFAULT = Taxonomy()


def _title_text(title: ColumnOrName, body: ColumnOrName, sep: str = " ") -> Column:
    return F.concat_ws(sep, text(title), text(body))


# -------------------------------------------------------------- categories
def _stems(pattern: str) -> list[str]:
    """Literal beginnings of the words of a keyword pattern."""
    out = []
    for word in re.split(r"[ \-]", pattern.replace(r"\b", "")):
        stem = re.match(r"[^\[\](?\\.*+|]*", word).group()
        rest = word[len(stem):len(stem) + 1]
        out.append(stem[:-1] if rest in ("?", "*") else stem)
    return out


def overlap_free_groups(patterns: list[str]) -> list[list[str]]:
    """Split patterns so that no two of a group can match overlapping text.

    Inside such a group one alternation counts exactly what the patterns would
    count one by one, so a category costs a few passes instead of one per pattern.
    """
    groups: list[list[str]] = []
    for p in patterns:
        for group in groups:
            clash = any(
                a.startswith(b) or b.startswith(a) for q in group for a in _stems(q) for b in _stems(p)
            )
            if not clash:
                group.append(p)
                break
        else:
            groups.append([p])
    return groups


def keyword_score(content: ColumnOrName, patterns: list[str]) -> Column:
    """Total number of matches of all patterns in a lower-cased text."""
    total = F.lit(0)
    for group in overlap_free_groups(patterns):
        total = total + F.regexp_count(col(content), F.lit("(?U)" + alternation(group)))
    letters = _first_letters(patterns)
    return F.when(F.rlike(col(content), F.lit(f"[{letters}]")), total).otherwise(0) if letters else total


def _first_letters(patterns: list[str]) -> str | None:
    """The letters that the matches begin with, if each pattern begins a word with a fixed letter; else None."""
    leads = [re.match(r"\\b(\w)(?![?*{])", p) for p in patterns]
    branched = any("|" in re.sub(r"\[[^\]]*\]", "", p) for p in patterns)
    return "".join(sorted({m.group(1) for m in leads})) if leads and all(leads) and not branched else None


def alternation(patterns: list[str]) -> str:
    """One pattern for any of the patterns, tried in their order.

    If each of them begins a word with a fixed letter, these letters are looked for first, and the border of the word once for
    all of them, so that a character that begins no match costs one test.
    """
    letters = _first_letters(patterns)
    if letters is None:
        return "|".join(f"(?:{p})" for p in patterns)
    return rf"(?=[{letters}])\b(?:" + "|".join(f"(?:{p[2:]})" for p in patterns) + ")"


def category_scores(title: ColumnOrName, body: ColumnOrName, tax: Taxonomy = DEFAULT) -> Column:
    """Struct of keyword counts per category; the title counts twice."""
    content = F.lower(F.concat_ws(" ", text(title), text(title), text(body)))
    return let(content, lambda c: F.struct(*[keyword_score(c, p).alias(name) for name, p in tax.category_patterns.items()]))


def category_from_scores(s: Column) -> Column:
    """City and region compete first; then world with weight 1.5; ties in that order."""
    city, region, world = s["moscow"], s["moscow_region"], s["world"]
    return (
        F.when((city == 0) & (region == 0) & (world == 0), "russia")
        .when((city > 0) & (region > 0), F.when(region >= city, "moscow_region").otherwise("moscow"))
        .when((world > 0) & (world * 1.5 > F.greatest(city, region)), "world")
        .when((city >= region) & (city >= world), "moscow")
        .when(region >= world, "moscow_region")
        .otherwise("world")
    )


def classify(title: ColumnOrName, body: ColumnOrName, url: ColumnOrName, tax: Taxonomy = DEFAULT) -> Column:
    """Category of an item: markers of the address first, then keyword counts."""
    return F.coalesce(category_by_url(url), let(category_scores(title, body, tax), category_from_scores))


# -------------------------------------------------------------------- tags
def normalize_tag(c: ColumnOrName) -> Column:
    bare = F.regexp_replace(F.replace(strip(text(c)), F.lit("_"), F.lit("")), r"(?U)\s+", "")
    return F.when(bare == "", F.lit("")).when(F.startswith(bare, F.lit("#")), bare).otherwise(F.concat(F.lit("#"), bare))


def tag_key(c: ColumnOrName) -> Column:
    """Comparison key of a tag: normalised, lower case, ё as е."""
    return F.translate(F.lower(normalize_tag(c)), "ё", "е")


def _first_tag(content: Column, aliases: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(contains_any(content, names), F.lit(tag)) for tag, names in aliases.items()])


def geo_tags(title: ColumnOrName, body: ColumnOrName, language: ColumnOrName | None = None,
             tax: Taxonomy = DEFAULT) -> Column:
    """Struct g0..g3: world or country, district, region, city."""
    lang = F.lower(F.coalesce(col(language), F.lit("ru"))) if language is not None else F.lit("ru")

    def found(content: Column) -> Column:
        return F.struct(
            _first_tag(content, tax.region_aliases).alias("region"), _first_tag(content, tax.city_aliases).alias("city"),
            contains_any(content, tax.world_markers).alias("world"), contains_any(content, tax.russia_markers).alias("russia"),
            lang.alias("lang"),
        )

    def placed(f: Column) -> Column:
        local = f["region"].isNotNull() | f["city"].isNotNull()
        russia = f["russia"] | local
        home = F.when(f["world"] & ~russia, F.lit(False)).when(russia & ~f["world"], F.lit(True)).otherwise(f["lang"] == "ru")
        region = F.coalesce(f["region"], F.when(f["city"] == tax.capital_tag, f["city"]).otherwise(lookup(f["city"], tax.city_regions)))
        return F.struct(home.alias("home"), (home & local).alias("placed"), region.alias("region"), f["city"].alias("city"))

    def tags(p: Column) -> Column:
        city = F.coalesce(p["city"], F.when(p["region"] == tax.capital_tag, p["region"]), lookup(p["region"], tax.region_capitals))
        return F.struct(
            F.when(p["home"], lx.RUSSIA).otherwise(lx.WORLD).alias("g0"), F.when(p["placed"], lx.CENTRAL_DISTRICT).alias("g1"),
            F.when(p["placed"], p["region"]).alias("g2"), F.when(p["placed"], city).alias("g3"),
        )

    return let(let(let(F.lower(_title_text(title, body)), found), placed), tags)


def rubric_tag(title: ColumnOrName, body: ColumnOrName, tax: Taxonomy = DEFAULT) -> Column:
    """First rubric one of whose word stems occurs anywhere."""
    return let(F.lower(_title_text(title, body)), lambda content: F.coalesce(_first_tag(content, tax.rubric_keywords), F.lit(lx.DEFAULT_RUBRIC)))


def _whole_word(content: Column, alternatives: str) -> Column:
    return content.rlike(rf"(?iuU)\b(?:{alternatives})\b")


def rubric_by_words(title: ColumnOrName, body: ColumnOrName, tax: Taxonomy = DEFAULT) -> Column:
    """First rubric one of whose keywords occurs as a whole word."""
    content = _title_text(title, body, "\n")
    out = None
    for tag, keys in tax.rubric_words.items():
        cond = _whole_word(content, "|".join(keys))
        out = F.when(cond, tag) if out is None else out.when(cond, tag)
    return out.otherwise(lx.DEFAULT_RUBRIC)


def strict_g0(title: ColumnOrName, body: ColumnOrName, tax: Taxonomy = DEFAULT) -> Column:
    """The country only on strong markers, else world (global technology alone never counts as the country)."""
    return F.when(_whole_word(_title_text(title, body, "\n"), tax.russia_strong), lx.RUSSIA).otherwise(lx.WORLD)


def allowlist(tax: Taxonomy = DEFAULT) -> dict[str, list[str]]:
    return {
        "g0": [lx.RUSSIA, lx.WORLD], "g1": lx.DISTRICTS, "g2": list(tax.region_aliases), "g3": list(tax.city_aliases),
        "r0": lx.RUBRICS,
    }


def validate_pack(pack: Column, tax: Taxonomy = DEFAULT) -> Column:
    """Drop tags outside the allow-list; a city equal to its region is dropped."""
    return let(pack, lambda p: _validated(p, allowlist(tax)))


def _validated(pack: Column, allow: dict[str, list[str]]) -> Column:
    g2 = F.when(pack["g2"].isin(allow["g2"]), pack["g2"])
    g3 = F.when(pack["g3"].isin(allow["g3"]), pack["g3"])
    same = F.coalesce(tag_key(g2) == tag_key(g3), F.lit(False)) & g2.isNotNull() & g3.isNotNull()
    return F.struct(
        F.when(pack["g0"].isin(allow["g0"]), pack["g0"]).otherwise(lx.WORLD).alias("g0"),
        F.when(pack["g1"].isin(allow["g1"]), pack["g1"]).alias("g1"),
        g2.alias("g2"),
        F.when(~same, g3).alias("g3"),
        F.when(pack["r0"].isin(allow["r0"]), pack["r0"]).otherwise(lx.DEFAULT_RUBRIC).alias("r0"),
    )


def distinct_tags(arr: Column) -> Column:
    return keep_first(F.filter(arr, lambda t: t.isNotNull() & (t != "")), tag_key)


def ordered_tags(pack: Column) -> Column:
    """World: [g0, r0]; country: [g0, g1?, g2?, g3?, r0]; repeats dropped."""
    listed = let(pack, lambda p: F.when(p["g0"] == lx.WORLD, F.array(p["g0"], p["r0"])).otherwise(
        F.array(p["g0"], p["g1"], p["g2"], p["g3"], p["r0"])))
    return let(listed, distinct_tags)


def item_tags(title: ColumnOrName, body: ColumnOrName, tax: Taxonomy = DEFAULT) -> Column:
    """Full tag list, whole-word rubric form."""
    seen = F.struct(strict_g0(title, body, tax).alias("g0"), geo_tags(title, body, None, tax).alias("geo"),
                    rubric_by_words(title, body, tax).alias("r0"))

    def pack(s: Column) -> Column:
        home, geo = s["g0"] == lx.RUSSIA, s["geo"]
        district = F.coalesce(geo["g1"], F.when(geo["g2"].isNotNull() | geo["g3"].isNotNull(), lx.CENTRAL_DISTRICT))
        return F.struct(s["g0"].alias("g0"), F.when(home, district).alias("g1"), F.when(home, geo["g2"]).alias("g2"),
                        F.when(home, geo["g3"]).alias("g3"), s["r0"].alias("r0"))

    return ordered_tags(validate_pack(let(seen, pack), tax))


def stored_tags(title: ColumnOrName, body: ColumnOrName, language: ColumnOrName | None = None,
                tax: Taxonomy = DEFAULT) -> Column:
    """Full tag list as stored with the item, stem rubric form."""
    seen = F.struct(strict_g0(title, body, tax).alias("g0"), geo_tags(title, body, language, tax).alias("geo"),
                    rubric_tag(title, body, tax).alias("r0"))

    def pack(s: Column) -> Column:
        home = (s["g0"] == lx.RUSSIA) & (s["geo"]["g1"] == lx.CENTRAL_DISTRICT)
        return F.struct(s["g0"].alias("g0"), *[F.when(home, s["geo"][k]).alias(k) for k in ("g1", "g2", "g3")], s["r0"].alias("r0"))

    return ordered_tags(validate_pack(let(seen, pack), tax))


def english_tags(tags: Column, table: dict[str, str] | None = None) -> Column:
    """Tags through the RU → EN table; unknown ones stay."""
    mapping = table or lx.TAGS_EN
    normal = F.transform(F.filter(tags, lambda t: blank_to_null(t).isNotNull()), normalize_tag)
    return let(F.transform(normal, lambda t: lookup(t, mapping, t)), lambda arr: keep_first(arr, tag_key))


def category_tag(category: ColumnOrName, language: str = "ru") -> Column:
    return lookup(category, lx.CATEGORY_TAGS["en" if language == "en" else "ru"], F.lit(""))


def category_line(category: ColumnOrName, extra_tags: ColumnOrName | None = None, language: str = "ru") -> Column:
    """Emoji, category tag and further tags in one line."""
    emoji = lookup(category, lx.CATEGORY_EMOJI, F.lit(lx.DEFAULT_EMOJI))
    tags = category_tag(category, language)
    if extra_tags is not None:
        tags = strip(F.concat_ws(" ", tags, F.when(text(extra_tags) != "", col(extra_tags))))
    return strip(F.concat_ws(" ", emoji, tags))


def enforce_category_tag(tags: Column, category: ColumnOrName, language: str = "ru", limit: int = 8) -> Column:
    """The category's tag comes first if missing; city and region drop the country tag; at most eight."""
    required = category_tag(category, language)
    clean = F.transform(
        F.filter(tags, lambda t: blank_to_null(t).isNotNull()),
        lambda t: F.when(F.startswith(strip(t), F.lit("#")), strip(t)).otherwise(F.concat(F.lit("#"), strip(t))),
    )
    clean = keep_first(clean, F.lower)
    present = F.exists(clean, lambda t: F.lower(t) == F.lower(required))
    full = F.when(present, clean).otherwise(F.concat(F.array(required), clean))
    broad = "#russia" if language == "en" else "#россия"
    local = col(category).isin("moscow", "moscow_region")
    return F.slice(F.filter(full, lambda t: ~(local & (F.lower(t) == broad))), 1, limit)


# -------------------------------------------------------------- candidates
def candidate_terms(c: ColumnOrName) -> Column:
    return squeeze(F.regexp_replace(text(c), r"(?U)[^A-Za-zА-Яа-яЁё0-9\s]", ""))


def entities(c: ColumnOrName, language: str) -> Column:
    """Runs of capitalised words, three characters or more."""
    found = F.regexp_extract_all(text(c), F.lit("(?U)" + lx.ENTITY_PATTERNS["ru" if language == "ru" else "en"]), F.lit(0))
    return F.filter(F.transform(found, squeeze), lambda e: F.length(e) >= 3)


def to_hashtag(c: ColumnOrName) -> Column:
    return F.concat(F.lit("#"), F.replace(col(c), F.lit(" "), F.lit("")))


def merge_candidates(entity_terms: Column, keywords: Column, max_entities: int = 12, max_total: int = 20) -> Column:
    """Entities first (12 at most), then keywords, 20 in all, repeats dropped."""
    first = keep_first(F.transform(entity_terms, to_hashtag), F.lower, max_entities)
    return keep_first(F.concat(first, F.transform(keywords, to_hashtag)), F.lower, max_total)


def parse_tag_json(raw: ColumnOrName) -> Column:
    """Tags of a JSON list, or of the ``hashtags`` list of a JSON object; empty if neither."""
    body = strip(text(raw))
    listed = F.when(F.startswith(body, F.lit("[")), body).otherwise(F.get_json_object(body, "$.hashtags"))
    tags = F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))
    tags = F.filter(tags, lambda t: blank_to_null(t).isNotNull())
    return F.array_distinct(F.transform(
        tags, lambda t: F.when(F.startswith(strip(t), F.lit("#")), strip(t)).otherwise(F.concat(F.lit("#"), strip(t)))
    ))


def parse_pack_json(raw: ColumnOrName, tax: Taxonomy = DEFAULT) -> Column:
    """Tag pack of a JSON object; null if it is no object or holds a tag outside the allow-list."""
    allow = allowlist(tax)
    data = F.from_json(strip(text(raw)), "struct<g0:string,g1:string,g2:string,g3:string,r0:string>")
    ok = F.startswith(strip(text(raw)), F.lit("{")) & data.isNotNull()
    for key, tags in allow.items():
        ok = ok & (data[key].isNull() | normalize_tag(data[key]).isin(tags))
    return F.when(ok, F.struct(*[F.when(data[k].isNotNull(), normalize_tag(data[k])).alias(k) for k in allow]))


def only_common_tags(tags: Column, language: str) -> Column:
    common = strings(lx.COMMON_TAGS["ru" if language == "ru" else "en"])
    filled = F.filter(tags, lambda t: t != "")
    return (F.size(filled) > 0) & F.forall(filled, lambda t: F.array_contains(common, F.lower(t)))


def top_up_tags(tags: Column, candidates: Column, body: ColumnOrName, language: str,
                min_chars: int = 300, add: int = 3, limit: int = 8) -> Column:
    """Add up to three candidates when a long text got only common tags; eight at most."""
    clean = F.transform(
        F.filter(candidates, lambda t: blank_to_null(t).isNotNull()),
        lambda t: F.when(F.startswith(strip(t), F.lit("#")), strip(t)).otherwise(F.concat(F.lit("#"), strip(t))),
    )
    fresh = F.slice(F.filter(F.array_distinct(clean), lambda t: ~F.array_contains(tags, t)), 1, add)
    thin = only_common_tags(tags, language) & (F.length(text(body)) > min_chars)
    return F.slice(F.when(thin, F.concat(tags, fresh)).otherwise(tags), 1, limit)
