"""The order of the mixed documents follows the schedule."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from newslake.llm import mixing


@pytest.fixture(scope="module")
def mixed(spark, checkpoints):
    """Copies of 3,000 documents of about 120 words; the first source holds half of them."""
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.pmod(F.xxhash64("id"), F.lit(60)) + 90).cast("int")).alias("text"),
        F.when(F.col("id") < 1500, "a").when(F.col("id") < 2300, "b").otherwise("c").alias("source"))
    return docs, mixing.mixed_texts(docs)


def test_prefixes_hold_the_target_shares(mixed):
    docs, out = mixed
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    total, seen, worst = sum(target.values()), Counter(), 0.0
    for r in out.select("source", F.regexp_count("text", F.lit("word")).alias("n")).collect():
        seen[r.source] += r.n
        done = sum(seen.values())
        if done >= total / 4:
            worst = max(worst, *(abs(seen[s] / done - target[s] / total) for s in target))
    assert all(abs(seen[s] - target[s]) <= 1 for s in target)
    assert worst <= 0.02, worst


def test_later_copies_come_at_their_own_slots(mixed):
    _, out = mixed
    order = [r.doc_id for r in out.select("doc_id").collect()]
    first, gaps = {}, []
    for place, doc in enumerate(order):
        if doc in first:
            gaps.append(place - first[doc])
        first.setdefault(doc, place)
    assert gaps and min(gaps) > len(order) // 10      # a second pass is not a copy beside the first
