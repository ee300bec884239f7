"""Idempotent appends, deletes, updates and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions import text as tx
from newslake.functions.base import first_filled, lookup, strip, text
from newslake.functions import lexicon as lx
from newslake.operators import gates
from newslake.operators.usage import upsert


#: Folders over which digests are spread.
DIGEST_FOLDERS = 256


def rows_to_insert(items: DataFrame, table: DataFrame, key: str = "url") -> DataFrame:
    """First new row per key that the table does not hold; chosen on keys alone, before the rows themselves move."""
    once = items.groupBy(key).agg(F.min("arrival_idx").alias("arrival_idx")).join(table.select(key).distinct(), key, "left_anti")
    same = once.select(F.col(key).alias("_k"), F.col("arrival_idx").alias("_idx"))
    return items.join(same, F.col(key).eqNullSafe(F.col("_k")) & (F.col("arrival_idx") == F.col("_idx")), "left_semi")


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def without_keys(table: DataFrame, gone: DataFrame, key: str = "url") -> DataFrame:
    """Table after deleting the given keys."""
    return table.join(gone.select(key).distinct(), key, "left_anti").select(*table.columns)


def update_columns(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Table after setting columns by key; keys without an update keep their values."""
    fresh = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(fresh, key, "left")
    have = set(table.columns)
    new = {c: F.coalesce(f"_{c}", c) if c in have else F.col(f"_{c}") for c in columns}
    return joined.withColumns(new).drop(*[f"_{c}" for c in columns])


def upsert_feed_state(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest etag and modification stamp per address."""
    return upsert(state, updates.filter(F.col("etag").isNotNull() | F.col("last_modified").isNotNull()), ["url"], ["ts"])


def digest_rows(selected: DataFrame) -> DataFrame:
    """Rows of a reader's digest: title, url, tag, cleaned text."""
    have = set(selected.columns)
    opt = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    body = F.coalesce(first_filled(opt("ai_summary"), opt("clean_text"), opt("lead_text")), F.lit("Текст недоступен"))
    return selected.select(
        "user_id", "id", "selected_at", strip(F.coalesce("title", F.lit("Без заголовка"))).alias("title"), strip(text("url")).alias("url"),
        lookup("category", lx.CATEGORY_TAGS["ru"], F.lit("#Россия")).alias("tag"), tx.digest_text(body).alias("body"))


def write_digests(rows: DataFrame, path: str) -> None:
    """Folders by a hash of the user, so that their number is fixed; files hold runs of users, newest selection first."""
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(DIGEST_FOLDERS)))
    (placed.repartitionByRange(F.col("bucket"), F.col("user_id"), F.desc("selected_at"))
     .sortWithinPartitions("bucket", "user_id", F.desc("selected_at"))
     .write.mode("overwrite").partitionBy("bucket").option("header", True).csv(path))


def write_export(items: DataFrame, path: str) -> None:
    gates.export_rows(items).write.mode("overwrite").option("header", True).csv(path)


def audit_report(counts: DataFrame, orphans: DataFrame, status: DataFrame, generated_at: Column) -> DataFrame:
    """One row with the counts, checks and verdict of an audit."""
    as_map = lambda df, v: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", v))))).scalar()
    return status.select(
        "overall_status", "errors", "warnings", as_map(counts, "n").alias("table_counts"),
        as_map(orphans, "orphans").alias("orphans"), generated_at.alias("generated_at"))


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)  # one row by construction
