"""Integrity and completeness checks over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions.base import text
from newslake.operators import ordered


def orphans(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows per table whose reference is missing: {name: (rows, column, parent, key)}."""
    parts = [
        rows.join(parent.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")
        .agg(F.lit(name).alias("table_name"), F.count("*").alias("orphans"))
        for name, (rows, ref, parent, key) in checks.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, df in tables.items()])


def completeness(items: DataFrame, columns: list[str]) -> DataFrame:
    """Total and items without a value, per column."""
    return items.agg(F.count("*").alias("total"), *[
        F.count_if(text(F.col(c)) == "").alias(f"missing_{c}") for c in columns])


def log_summary(log_lines: DataFrame, last: int = 500) -> DataFrame:
    """ERROR and WARNING lines among the last lines of each file."""
    tail = ordered.first_n(log_lines, ["file"], [F.desc("line_no")], last)
    return tail.groupBy("file").agg(
        F.count_if(F.col("line").rlike(r"(?U)\bERROR\b")).alias("errors"),
        F.count_if(F.col("line").rlike(r"(?U)\bWARNING\b")).alias("warnings"))


def overall_status(checks: DataFrame, core_ok: Column, log: DataFrame | None = None) -> DataFrame:
    """One row: error and warning counts and the overall verdict.

    ``checks`` has a ``status`` column (OK / WARNING / ERROR); ``core_ok`` is an
    aggregate that is true while the core parts work.
    """
    base = checks.agg(F.count_if(F.col("status") == "ERROR").alias("errors"),
                      F.count_if(F.col("status") == "WARNING").alias("warnings"), core_ok.alias("core_ok"))
    if log is not None:
        tot = log.agg(F.struct(F.coalesce(F.sum("errors"), F.lit(0)).alias("e"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("w"))).scalar()
        has = tot["e"] > 0
        base = base.withColumn("errors", F.col("errors") + F.when(has, tot["e"]).otherwise(0)) \
            .withColumn("warnings", F.col("warnings") + F.when(has, tot["w"]).otherwise(0))
    return base.withColumn(
        "overall_status", F.when(~F.col("core_ok"), "critical")
        .when((F.col("errors") > 0) | (F.col("warnings") > 0), "degraded").otherwise("normal"))


def tick_stats(items: DataFrame, tick: str = "tick_id", published: str = "published") -> DataFrame:
    """Fetched, published and deduplicated items per tick."""
    return items.groupBy(tick).agg(F.count("*").alias("fetched"), F.count_if(published).alias("published")) \
        .withColumn("deduped", F.greatest(F.lit(0), F.col("fetched") - F.col("published")))
