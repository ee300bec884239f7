"""Order-sensitive building blocks that never put a whole key into one task.

A key (a source, a user, a tick) may hold a third of all rows, so running states
are computed in two levels: inside ``(key, time chunk)`` groups, and over one
summary row per chunk that carries the state from chunk to chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslake.session import cut

HOUR = 3600


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows per key.  Spark limits each key before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key by partial aggregation, so a hot key costs one row per task."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Last row per key (the result of a chain of upserts)."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def global_row_number(df: DataFrame, order: Sequence[str], name: str = "row_no", start: int | Column = 0) -> DataFrame:
    """Dense numbers 1, 2, … in a global order without one task seeing all rows.

    Rows are range-partitioned and written to the checkpoint folder, so that the
    partitions stay fixed; each partition numbers its own rows and adds the sizes
    of the partitions before it (one small row per partition).
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_p",
        F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
    )
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    offset = F.lit(start) if isinstance(start, int) else start
    return (
        placed.join(F.broadcast(before), "_p")  # one row per partition
        .withColumn(name, (local + F.col("_before") + offset).cast("long"))
        .drop("_p", "_before")
    )


def _chunk(ts: Column, width: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(width * 1_000_000))


def last_value_before(df: DataFrame, key: str, ts: str, tie: str, value: str, out: str, width: int = HOUR) -> DataFrame:
    """For each row the last non-null ``value`` among the earlier rows of its key (as-of state)."""
    rows = df.withColumn("_c", _chunk(F.col(ts), width))
    summary = rows.groupBy(key, "_c").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(ts, tie))).alias("_v")
    )
    over = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(F.col(key), "_c", F.last("_v", ignorenulls=True).over(over).alias("_carry"))
    inside = Window.partitionBy(key, "_c").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(carried, [key, "_c"])
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_c", "_carry")
    )


def rank_in_gap_sessions(df: DataFrame, key: str, ts: str, tie: str, gap_seconds: float, out: str = "streak_no",
                         inclusive: bool = False, width: int = HOUR) -> DataFrame:
    """Number rows inside gap sessions of a key: a pause longer than the gap starts again at 1.

    ``inclusive`` also splits at a pause of exactly the gap.  Adds ``out`` and
    ``session_start`` (time of the session's first row).
    """
    rows = df.withColumn("_c", _chunk(F.col(ts), width))
    over = Window.partitionBy(key).orderBy("_c")
    ends = rows.groupBy(key, "_c").agg(F.max(ts).alias("_end"))
    ends = ends.select(F.col(key), "_c", F.lag("_end").over(over).alias("_prev_end"))
    inside = Window.partitionBy(key, "_c").orderBy(ts, tie)
    rows = rows.join(ends, [key, "_c"])
    prev = F.coalesce(F.lag(ts).over(inside), F.col("_prev_end"))
    pause = (F.unix_micros(F.col(ts)) - F.unix_micros(prev)) / 1e6
    starts = prev.isNull() | ((pause >= gap_seconds) if inclusive else (pause > gap_seconds))
    rows = rows.withColumn("_new", starts.cast("int"))
    rows = rows.withColumn("_seg", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_c", "_seg").orderBy(ts, tie)))
    # chunk summary: rows after the chunk's last session start, and that start
    tail = rows.groupBy(key, "_c").agg(
        F.max_by("_n", F.struct(ts, tie)).alias("_tail"), F.max("_new").alias("_has"),
        F.max(F.when(F.col("_new") == 1, F.col(ts))).alias("_start"),
    )
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    tail = tail.withColumn("_g", F.sum("_has").over(upto)).withColumn("_start", F.last("_start", ignorenulls=True).over(upto))
    tail = tail.withColumn(
        "_run", F.sum("_tail").over(Window.partitionBy(key, "_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0))
    )
    carry = tail.select(F.col(key), "_c", F.lag("_run").over(over).alias("_carry"), F.lag("_start").over(over).alias("_carry_start"))
    local_start = F.last(F.when(F.col("_new") == 1, F.col(ts)), ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.join(carry, [key, "_c"])
        .withColumn(out, F.col("_n") + F.when(F.col("_seg") == 0, F.coalesce("_carry", F.lit(0))).otherwise(F.lit(0)))
        .withColumn("session_start", F.coalesce(local_start, F.col("_carry_start")))
        .drop("_c", "_prev_end", "_new", "_seg", "_n", "_carry", "_carry_start")
    )


def rank_by_id(items: DataFrame, marks: DataFrame, item_id: str, mark_id: str, width: int = 100_000
               ) -> tuple[DataFrame, DataFrame]:
    """Dense rank of items by id, and for each distinct mark the number of items with an id up to it.

    Works on id ranges of a fixed width and on distinct marks (many users may share
    one), so no task sorts all ids and no pair of item and mark is formed.
    """
    both = items.select(F.col(item_id).cast("long").alias("_id"), F.lit(1).alias("_is")) \
        .unionByName(marks.select(F.col(mark_id).cast("long").alias("_id"), F.lit(0).alias("_is")).distinct())
    both = both.withColumn("_b", F.floor(F.col("_id") / width))
    sizes = both.groupBy("_b").agg(F.sum("_is").alias("_n"))
    # one row per id range; ranges are few against ids
    before = sizes.select("_b", F.coalesce(
        F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_b").orderBy("_id", F.desc("_is")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = both.join(before, "_b").withColumn("_rank", F.col("_before") + F.sum("_is").over(inside))
    return (
        ranked.filter("_is = 1").select(F.col("_id").alias(item_id), F.col("_rank").alias("id_rank")),
        ranked.filter("_is = 0").select(F.col("_id").alias(mark_id), F.col("_rank").alias("items_before")),
    )
