"""Connected components by alternating large-star and small-star rounds over keyed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """Label every node of the edges ``a``, ``b`` with the smallest node that it reaches: rows ``node``, ``component``.

    Nodes are of any type with an order; loops and edges with a null are dropped. The minimum of a hub comes from partial
    aggregates and is written out before its neighbours meet it, so that a join may split a hub's rows over tasks. Rounds
    are logarithmic in the longest path. No edges give an empty table.
    """
    links = cut(cut(edges).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _state(links)
    while seen[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        far = _lowest(both)
        links = cut(both.join(far, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .where("u <> v").distinct())
        near = _lowest(links)
        kept = links.join(near, "u")
        links = cut(kept.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
                    .where("u <> v").distinct())
        now = _state(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _lowest(links: DataFrame) -> DataFrame:
    return cut(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def _state(links: DataFrame) -> tuple:
    """Number and digest of the links; equal before and after a round only if the round changed nothing."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
