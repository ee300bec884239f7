"""Mixing of sources to target weights by a low-discrepancy schedule of equal blocks.

Slot n of the schedule takes the van der Corput point of n, which the cumulative target weights map to a source. Slots are
ranked per source. Each source's documents, in shuffled order, form a stream of words that repeats and is cut into blocks of
equal length; the k-th slot of a source takes its k-th block.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslake.llm.common import SPACE, WORD, cut, fresh, same_columns

WEIGHTS = (5, 2, 1)
#: Words of the mix in percent of all words, and how often a source may be taken at most.
SHARE_PERCENT = 150
MOST = 2
#: Words of a block.
BLOCK = 2048
#: Buckets of the shuffled order of a source, so that prefix sums over a large source are taken in pieces.
BUCKETS = 1024
#: Least number of slots or sources that are counted together, and of cells that spread the points; larger inputs take the
#: square root of their slots, so that neither a run nor the list of runs grows large.
CHUNK = 64
CELLS = 256
#: Bits of a slot number.
BITS = 48
SEED = 17


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Rows source, source_size, weight, target from rows source, source_size.

    Sources by code point, null last, take the weights in turn. Targets share ``SHARE_PERCENT`` of all words by weight; a
    target above its ceiling stops there, and the rest is shared anew until none is above. Each round of sharing is one
    aggregate, so the table of sources never leaves Spark; its ranks come from ranges and counts per range.
    """
    key = [F.col("source").isNull(), F.col("source")]
    ranged = cut(totals.repartitionByRange(*key).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    ranks = ranged.join(cut(parts.select("part", "before")), "part")
    ranks = ranks.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*key)) + F.col("before") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    table = cut(ranks.select("source", "source_size", "rank", weight.alias("weight"), (F.col("source_size") * F.lit(MOST)).cast("double").alias("most")))
    goal = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * SHARE_PERCENT / 100
    level = 0.0
    while True:
        full = F.col("weight") * level >= F.col("most")
        used, free = table.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        raised = (goal - used) / free
        if raised <= level:
            break
        level = raised
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("most")))


def schedule(table: DataFrame) -> DataFrame:
    """Slots of the mix: source, k (rank of the slot in its source), slot (place in the mix).

    ``table`` has rank, target (words) and source. Sources that the points leave short of blocks get the missing ones at
    the end, and slots beyond a source's last block are dropped; both are few, as the points are of low discrepancy.
    """
    quota = F.ceil(F.round(F.col("target")) / BLOCK)
    total = table.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum(quota), F.lit(0)), F.count("*")).first()
    words, slots, cells = total[0], int(total[1]), max(CELLS, int(total[2]))
    chunk = max(CHUNK, isqrt(slots))
    if not slots:
        return table.select("source", "rank", F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("slot")).where("false")
    # Cumulative weights, from sums over runs of ranks and sums within a run.
    run = F.floor(F.col("rank") / chunk)
    runs = table.groupBy(run.alias("run")).agg(F.sum("target").alias("part"))
    runs = cut(runs.withColumn("base", F.coalesce(F.sum("part").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("part"))
    inside = F.sum("target").over(Window.partitionBy("run").orderBy("rank"))
    spans = table.withColumn("run", run).join(runs, "run").withColumn("hi", F.col("base") + inside)
    spans = spans.select("source", "rank", quota.alias("quota"), ((F.col("hi") - F.col("target")) / words).alias("lo"), (F.col("hi") / words).alias("hi"))
    # Every span lies in the cells that it touches; points spread evenly over the cells.
    cell = lambda p: F.least(F.floor(p * cells), F.lit(cells - 1)).cast("bigint")
    spans = cut(spans.where("quota > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi"))))))
    n = F.col("id")
    point = F.conv(F.reverse(F.lpad(F.bin(n), BITS, "0")), 2, 10).cast("double") / float(1 << BITS)
    points = table.sparkSession.range(slots).withColumn("p", point).withColumn("cell", cell(F.col("p")))
    hit = points.join(spans, "cell").where("p >= lo AND p < hi").select("rank", "source", "quota", n.alias("slot"))
    hit = cut(hit.withColumn("chunk", F.floor(F.col("slot") / chunk)))
    chunks = hit.groupBy("rank", "chunk").count()
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = cut(chunks.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))))
    k = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")) - 1 + F.col("before")
    ranked = hit.join(chunks.drop("count"), ["rank", "chunk"]).withColumn("k", k).where("k < quota").select("source", "rank", "k", "slot")
    got = cut(chunks.groupBy("rank").agg(F.sum("count").alias("got")))
    short = table.select("source", "rank", quota.alias("quota")).join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    rest = short.where("got < quota").select("source", "rank", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("k"))
    return ranked.union(rest.select("source", "rank", "k", F.lit(slots).cast("bigint") + F.col("k")))


def streams(sized: DataFrame, table: DataFrame) -> DataFrame:
    """Documents with ``start``, the place of their first word in their source's shuffled stream.

    The order is by a seeded hash of the id; ids that meet are ordered by size and row.
    """
    mixed = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("source"))
    rows = sized.withColumn("h", mixed).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(BUCKETS)))
    known = cut(rows.join(table.select(F.col("source").alias("s"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    sums = known.groupBy("rank", "bucket").agg(F.sum("size").alias("part"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("base", F.coalesce(F.sum("part").over(before), F.lit(0))).drop("part"))
    inside = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    return known.join(sums, ["rank", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def mix(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Rows row, doc_id, source, size, source_size, target, taken (words, repeats counted), first_slot (place in the mix) and
    pass_slots (the first slot of each pass over the source that takes the document).

    ``row`` names a column that identifies the rows; without one they are numbered.

    A null text has size 0 and a null source is a source; empty documents are taken with 0 words. Repeated ids are rows
    of their own. Without words every target is 0; an empty table gives an empty one. Reruns agree, as the order hangs on
    hashes of ids only. Documents of a source meet in blocks of ``BLOCK`` words and in buckets of the shuffled order,
    never as a whole source.
    """
    row = F.col(row) if row else F.monotonically_increasing_id()
    sized = cut(docs.select("doc_id", "source", sizes(docs).alias("size"), row.alias("row")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = cut(targets(cut(totals)))
    slots = cut(schedule(table))
    placed = cut(streams(sized, table))
    # A document covers places of the repeated stream once per pass; each piece of it lies in one block.
    passes = placed.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))))
    first = F.col("start") + F.col("turn") * F.col("source_size")
    passes = passes.select("row", "turn", "rank", "target", "size", first.alias("lo"), (first + F.col("size")).alias("hi"))
    passes = passes.where(F.col("lo") < F.round("target"))
    block = lambda at: F.floor(at / BLOCK)
    pieces = passes.withColumn("k", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1))))
    most = F.least(F.col("hi"), (F.col("k") + 1) * BLOCK, F.round("target").cast("bigint"))
    words = F.greatest(F.lit(0).cast("bigint"), most - F.greatest(F.col("lo"), F.col("k") * BLOCK))
    taken = pieces.select("row", "turn", "rank", "k", words.alias("words")).join(slots, ["rank", "k"])
    each = F.array(*[F.min(F.when(F.col("turn") == n, F.col("slot"))) for n in range(MOST)])
    taken = cut(taken.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), each.alias("pass_slots")))
    return placed.join(taken, "row", "left").select(
        "row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot", "pass_slots")


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as documents: a copy per pass that takes the document, the last one cut where its source's target ends.

    Copies are in the order of the schedule's slots, by ranges of slots and sorted within them, so that every prefix of the
    output holds the sources near their weights.

    Null texts and texts without words are not taken. Repeated rows and ids are rows of their own. Other columns come
    through as they are, whatever their names; an empty table gives an empty one.
    """
    own = fresh(docs)
    row, size, taken, copy, slots, slot = (f"{own}{n}" for n in ("row", "size", "taken", "copy", "slots", "slot"))
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = mix(numbered, row).where("taken > 0")
    plan = plan.select(F.col("row").alias(row), F.col("size").alias(size), F.col("taken").alias(taken), F.col("pass_slots").alias(slots))
    plan = plan.withColumn(copy, F.explode(F.expr(f"sequence(0L, ({taken} - 1) div {size})")))
    plan = cut(plan.withColumn(slot, F.get(F.col(slots), F.col(copy).cast("int"))).drop(slots))
    copies = numbered.join(plan, row).repartitionByRange(slot, row).sortWithinPartitions(slot, row)
    left = F.col(taken) - F.col(copy) * F.col(size)
    head = F.concat(F.lit(f"^(?:{SPACE.replace('+', '*+')}{WORD}+){{"), left.cast("string"), F.lit("}+"))  # possessive: no stack
    part = F.call_function("regexp_extract", F.col("text"), head, F.lit(0))
    return copies.withColumn("text", F.when(left >= F.col(size), F.col("text")).otherwise(part)).select(*same_columns(docs))
