"""Source health, drop reasons and counters over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions import lexicon as lx
from newslake.functions.base import any_of, text
from newslake.operators import ordered


def recent(df: DataFrame, ts: str, as_of: Column, hours: int, inclusive: bool = False) -> DataFrame:
    """Rows of the last hours.  A plain range predicate, so it reaches the Parquet scan."""
    start = as_of - F.make_dt_interval(hours=F.lit(hours))
    return df.filter(F.col(ts) >= start if inclusive else F.col(ts) > start)


def item_totals(items: DataFrame, as_of: Column) -> DataFrame:
    day = as_of - F.expr("interval 1 day")
    return items.agg(F.count("*").alias("total"), F.count_if(F.col("published_at") > day).alias("today"))


def counts_for_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items per listed source, zero where there are none."""
    counts = items.groupBy("source").agg(F.count("*").alias("n"))
    return sources.select("source").join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def counts_by_source(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


_KINDS = ["success", "error", "drop_old", "drop_date"]


def event_counts(events: DataFrame, sources: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Events by type per listed source in the last hours, zero-filled."""
    counts = recent(events, "created_at", as_of, hours, inclusive=True).groupBy("source").agg(
        *[F.count_if(F.col("event_type") == k).alias(f"{k}_count") for k in _KINDS]
    )
    return sources.select("source").join(counts, "source", "left").select(
        "source", *[F.coalesce(f"{k}_count", F.lit(0)).alias(f"{k}_count") for k in _KINDS]
    )


def health_snapshot(events: DataFrame) -> DataFrame:
    """Latest success and latest error of each source (message cut to 300)."""
    is_error = F.col("event_type") == "error"
    last = F.max_by(
        F.struct("error_code", F.substring(F.trim("error_message"), 1, 300).alias("message")),
        F.when(is_error, F.struct("created_at", "id")),
    )
    return events.groupBy("source").agg(
        F.max(F.when(F.col("event_type") == "success", F.col("created_at"))).alias("last_success_at"),
        F.max(F.when(is_error, F.col("created_at"))).alias("last_error_at"),
        last.alias("_e"),
    ).select("source", "last_success_at", "last_error_at", F.col("_e.error_code").alias("last_error_code"),
             F.col("_e.message").alias("last_error_message")
             ).filter(F.col("last_success_at").isNotNull() | F.col("last_error_at").isNotNull())


def last_drop_codes(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Code of the newest date drop of each source, ties by id."""
    drops = recent(events, "created_at", as_of, hours, inclusive=True).filter("event_type = 'drop_date'")
    return drops.groupBy("source").agg(F.max_by("error_code", F.struct("created_at", "id")).alias("error_code"))


def error_rate(success: Column, error: Column) -> Column:
    return F.when(success + error > 0, error / (success + error)).otherwise(F.lit(0.0))


def with_status(board: DataFrame, limit: float = 0.5) -> DataFrame:
    """Rate, colour and status text of each source of a board."""
    s, e, old, date = (F.col(f"{k}_count") for k in _KINDS)
    green = (s > 0) & (error_rate(s, e) < limit)
    return board.withColumn("error_rate", error_rate(s, e)).withColumn(
        "colour", F.when(green, "green").when(e > 0, "red").otherwise("yellow")
    ).withColumn(
        "status",
        F.when(green, F.concat(s.cast("string"), F.lit(" новости (24ч)")))
        .when(e > 0, F.coalesce(F.when(F.col("last_error_code") != "", F.col("last_error_code")), F.lit("FETCH_ERROR")))
        .when(old > 0, "OLD_PUBLISHED_AT")
        .when(date > 0, F.coalesce(F.when(F.col("drop_code") != "", F.col("drop_code")), F.lit("NO_PUBLISHED_DATE")))
        .otherwise("FETCH_OK_NO_MATCH"),
    )


def status_board(sources: DataFrame, events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Source list with event counts, health, last drop code and status.

    The three summaries share the grouping key, so they come from one pass over
    the log and one shuffle of partial sums instead of three.
    """
    start = as_of - F.make_dt_interval(hours=F.lit(hours))
    fresh = F.col("created_at") >= start
    kind = F.col("event_type")
    stamp = F.struct("created_at", "id")
    summary = events.groupBy("source").agg(
        *[F.count_if(fresh & (kind == k)).alias(f"{k}_count") for k in _KINDS],
        F.max_by("error_code", F.when(kind == "error", stamp)).alias("last_error_code"),
        F.max_by("error_code", F.when(fresh & (kind == "drop_date"), stamp)).alias("drop_code"),
    )
    board = sources.join(summary, "source", "left")
    board = board.select(
        *sources.columns, *[F.coalesce(f"{k}_count", F.lit(0)).alias(f"{k}_count") for k in _KINDS],
        "last_error_code", "drop_code",
    )
    return with_status(board)


def drops_by_domain(items: DataFrame) -> DataFrame:
    """Rejected items per domain and reason; the pairs are few, so they are counted before the shuffle."""
    return items.filter(F.col("reason").isNotNull()).groupBy("domain", "reason").agg(F.count("*").alias("n"))


def nested_drops(drops: DataFrame) -> DataFrame:
    """One map of reason → count per domain (a domain has as many entries as there are reasons)."""
    return drops.groupBy("domain").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))


def keep_drop_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("kept"),
        F.count_if(F.col("reason").isNotNull()).alias("dropped"),
    )


def silent_sources(catalogue: DataFrame, items: DataFrame) -> DataFrame:
    """Configured sources without a single item."""
    return catalogue.select("source").distinct().join(items.select("source"), "source", "left_anti")


def error_code(status: Column, message: Column) -> Column:
    """Error code of a failed fetch from its status and message."""
    low = F.lower(text(message))
    return (
        F.when(status.isNotNull() & (status != 0), F.concat(F.lit("HTTP_"), status.cast("string")))
        .when(F.contains(low, F.lit("timeout")), "TIMEOUT")
        .when(low.rlike(any_of(["dns", "name or service not known"])), "CONNECTION_ERROR")
        .when(low.rlike(any_of(["parse", "json"])), "PARSE_ERROR")
        .otherwise("FETCH_ERROR")
    )


def error_streaks(failures: DataFrame, gap: int = lx.STREAK_GAP_SECONDS, limit: int = lx.STREAK_LIMIT,
                  seconds: int = lx.STREAK_COOLDOWN_SECONDS) -> DataFrame:
    """Number failures inside error streaks; every ``limit``-th fires a cooldown."""
    ranked = ordered.rank_in_gap_sessions(failures, "url", "ts", "id", gap)
    fires = F.col("streak_no") % limit == 0
    return ranked.withColumn("fires", fires).withColumn(
        "until", F.when(fires, F.col("ts") + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))))


def cooldown_until(kind: Column, status: Column, ts: Column) -> Column:
    """End of the cooldown a response sets, null if it sets none."""
    seconds = F.lit(None).cast("int")
    for k, table in lx.COOLDOWN_SECONDS.items():
        for code, secs in table.items():
            seconds = F.when((kind == k) & (status == code), F.lit(secs)).otherwise(seconds)
    return F.when(seconds.isNotNull(), ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))


def cooldown_states(fetches: DataFrame, with_streaks: bool = True) -> DataFrame:
    """For each fetch: was its address in cooldown?  The last cooldown set before it decides."""
    rows = fetches.withColumn("sets", cooldown_until(F.col("kind"), F.col("status"), F.col("ts")))
    if with_streaks:
        # a firing streak is noted after the response's own cooldown and so overrides it
        fired = error_streaks(rows.filter("failed")).filter("fires").select("id", F.col("until").alias("_fired"))
        rows = rows.join(fired, "id", "left").withColumn("sets", F.coalesce("_fired", "sets")).drop("_fired")
    state = ordered.last_value_before(rows, "url", "ts", "id", "sets", "until")
    return state.withColumn("in_cooldown", F.coalesce(F.col("until") > F.col("ts"), F.lit(False)))
