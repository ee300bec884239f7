"""Tag candidates of items: named entities and frequent words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.functions import lexicon as lx, tagging as tg
from newslake.functions.base import prefix, strip, text
from newslake.operators import ordered

# First positions of words that occur only in the title part of the count.
_AFTER_BODY = 1_000_000_000


def _sample(sample_chars: int | None):
    full = strip(F.concat_ws("\n", text("title"), text("body")))
    return full if sample_chars is None else prefix(full, sample_chars)


def top_keywords(items: DataFrame, language: str, n: int = 20, sample_chars: int | None = None) -> DataFrame:
    """Most frequent words per item, title words weighing two more; ties in order of first appearance.

    Words are counted per (item, word) before the shuffle; the ranking then keeps ``n`` rows per item.
    """
    stop = lx.CANDIDATE_STOPWORDS["ru" if language == "ru" else "en"]
    token = lambda c: F.regexp_extract_all(c, F.lit(lx.WORD_PATTERN), F.lit(0))
    body = items.select("id", F.posexplode(token(_sample(sample_chars))).alias("pos", "w")).select("id", "pos", F.lower("w").alias("word"))
    body = body.filter((F.length("word") >= 3) & ~F.col("word").rlike("^[0-9]+$") & ~F.col("word").isin(stop))
    head = items.select("id", F.posexplode(token(text("title"))).alias("pos", "w")).select(
        "id", (F.col("pos") + _AFTER_BODY).alias("pos"), F.lower("w").alias("word"))
    rows = body.withColumn("weight", F.lit(1)).unionByName(head.withColumn("weight", F.lit(2)))
    counts = rows.groupBy("id", "word").agg(F.sum("weight").alias("n"), F.min("pos").alias("first_pos"))
    return ordered.first_n(counts, ["id"], [F.desc("n"), "first_pos"], n)


def tag_candidates(items: DataFrame, language: str, sample_chars: int | None = None, max_entities: int = 12,
                   max_total: int = 20) -> DataFrame:
    """Candidates per item: entities of the title (and of the text if those are few), then top keywords.

    ``sample_chars`` limits the text that is looked at, for consumers with a budget; the whole
    text is used by default.
    """
    named = tg.entities("title", language)
    named = F.when(F.size(named) < 6, F.concat(named, tg.entities(_sample(sample_chars), language))).otherwise(named)
    words = top_keywords(items, language, sample_chars=sample_chars).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first_pos", "word"))).alias("_w"))
    rows = items.select("id", named.alias("_e")).join(words, "id", "left")
    keywords = F.transform(F.coalesce("_w", F.array().cast("array<struct<o:bigint,first_pos:int,word:string>>")), lambda w: w["word"])
    return rows.select("id", tg.merge_candidates(F.col("_e"), keywords, max_entities, max_total).alias("candidates"))
