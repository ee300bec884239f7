"""Call gates and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslake.functions import lexicon as lx
from newslake.functions.base import strings
from newslake.operators import ordered
from newslake.session import cut


def gate_calls(calls: DataFrame, max_calls: int) -> DataFrame:
    """Allow the first ``max_calls`` calls of each tick (0 or less: all)."""
    if max_calls <= 0:
        return calls.withColumn("allowed", F.lit(True))
    edge = ordered.first_n(calls.select("tick_id", "call_no"), ["tick_id"], ["call_no"], max_calls) \
        .groupBy("tick_id").agg(F.max("call_no").alias("_edge"))
    return calls.join(edge, "tick_id").withColumn("allowed", F.col("call_no") <= F.col("_edge")).drop("_edge")


def disabled_tasks(calls: DataFrame, max_calls: int, order: list[str] | None = None) -> DataFrame:
    """Tasks a tick's refusals disable: each refusal of a task that is still on disables the next in order.

    Only the first few refusals of each task can matter, so a tick folds a
    handful of rows however many calls it had.
    """
    names = order or lx.DEGRADE_ORDER
    refused = gate_calls(calls, max_calls).filter(~F.col("allowed"))
    early = ordered.first_n(refused, ["tick_id", "task"], ["call_no"], len(names))
    folded = early.groupBy("tick_id").agg(F.array_sort(F.collect_list(F.struct("call_no", "task"))).alias("_r"))
    steps = strings(names)

    def step(off: Column, r: Column) -> Column:
        turn = ~F.array_contains(off, r["task"]) & (F.size(off) < len(names))
        return F.when(turn, F.concat(off, F.array(F.get(steps, F.size(off))))).otherwise(off)

    off = F.aggregate("_r", F.array().cast("array<string>"), step)
    return folded.select("tick_id", F.array_sort(off).alias("disabled"))


def rate_limited(requests: DataFrame, limit: int = 3, seconds: int = 60, width: int = ordered.HOUR) -> DataFrame:
    """Greedy rate limit: a request passes if fewer than ``limit`` passed requests of its user are younger than ``seconds``.

    Refused requests do not count.  Requests are folded inside (user, time chunk)
    groups; the state that crosses a chunk border is the last ``limit`` passed times.  Chunks start with an empty
    state and are folded again, in parallel, until no border state changes; a quiet
    ``seconds`` anywhere in a chunk already makes its end independent of its start.
    """
    micros = F.unix_micros("ts")
    chunked = requests.groupBy("user_id", F.floor(micros / F.lit(width * 1_000_000)).alias("_c")).agg(
        F.array_sort(F.collect_list(F.struct(micros.alias("t"), F.col("id").alias("id")))).alias("_reqs"))
    chunked = cut(chunked)
    span = seconds * 1_000_000

    def fold(entry: Column) -> Column:
        start = F.struct(entry.alias("live"), F.array().cast("array<bigint>").alias("passed"))

        def step(st: Column, r: Column) -> Column:
            live = F.filter(st["live"], lambda t: r["t"] - t < span)
            ok = F.size(live) < limit
            return F.struct(
                F.when(ok, F.concat(live, F.array(r["t"]))).otherwise(live).alias("live"),
                F.when(ok, F.concat(st["passed"], F.array(r["id"]))).otherwise(st["passed"]).alias("passed"))

        return F.aggregate("_reqs", start, step)

    def folded(df: DataFrame) -> DataFrame:
        return df.withColumn("_f", fold(F.col("_entry")))

    state = cut(folded(chunked.withColumn("_entry", F.array().cast("array<bigint>"))))
    first_t = F.col("_reqs")[0]["t"]
    while True:
        # the border state of a chunk is the end state of the chunk before it, less what has expired
        borders = state.select("user_id", "_c", "_entry", first_t.alias("_t0"), F.col("_f.live").alias("_end"))
        prev = F.lag("_end").over(Window.partitionBy("user_id").orderBy("_c"))
        borders = borders.withColumn("_p", F.coalesce(prev, F.array().cast("array<bigint>"))) \
            .withColumn("_next", F.filter("_p", lambda t: F.col("_t0") - t < span))
        changed = cut(borders.filter(F.col("_next") != F.col("_entry")).select("user_id", "_c", "_next"))
        if changed.count() == 0:
            break
        again = folded(state.join(changed, ["user_id", "_c"]).withColumn("_entry", F.col("_next")).drop("_next"))
        state = cut(state.join(changed, ["user_id", "_c"], "left_anti").unionByName(again))
    passed = state.select("user_id", F.explode("_f.passed").alias("id")).withColumn("accepted", F.lit(True))
    return requests.join(passed, ["user_id", "id"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
