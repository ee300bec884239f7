"""Near-duplicate documents by b-bit MinHash, with exact links.

Signatures keep the low bits of many minima. Documents that agree on a band of minima are candidates; in each bucket the
packed signatures estimate similarity, corrected for values that agree by chance, and pairs that may reach the threshold are
compared on their full shingle sets. Tasks return only links that join something new, never all pairs of a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import cut, fresh, tidy
from newslake.llm.graph import components
from newslake.llm.shingles import MinHash, batch_words, shingle_set

#: Links need 100 * intersection >= percent * union: the contract of the query, and the threshold of the pipeline's stage.
PERCENT = 85
STAGE_PERCENT = 80
#: A pair at the threshold shares none of the bands, or has too low an estimate, with at most about this probability each.
MISSED = 1e-6
#: Bands hold as many minima as so many bands allow; a lower threshold takes bands of fewer minima.
MOST_BANDS = 28
#: Minima in a signature, of which each keeps its low BITS; the first ones also form the bands.
MINIMA, BITS = 256, 8
#: Pairs estimated so many standard deviations below the threshold are not compared; fewer than ``MISSED`` lie beyond.
DEVIATIONS = 4.75
#: Rows of a bucket that meet in one block; larger buckets are compared block by block.
BLOCK = 384
#: Bytes of texts that are hashed together.
RUN = 1 << 21

SIGNED = "doc_id long, row long, mark long, n_shingles long, digest binary, keys array<bigint>, signature binary"


def bands_for(percent: int) -> tuple[int, int]:
    """Number of bands and minima of each: 24 of 5 at 85 percent, 27 of 4 at 80."""
    if not 50 <= percent <= 99:
        raise ValueError(f"percent must lie between 50 and 99: {percent}")
    needed = {rows: ceil(log(MISSED) / log(1 - (percent / 100) ** rows)) for rows in range(1, 9)}
    rows = max(r for r, bands in needed.items() if bands <= MOST_BANDS)
    return needed[rows], rows


def least_estimate(percent: int) -> float:
    """Pairs estimated below are not compared: about 0.74 at 85 percent, 0.68 at 80."""
    share = percent / 100
    return share - DEVIATIONS * sqrt(share * (1 - share) / MINIMA)


class Signer:
    """Signature and band keys of shingle sets."""

    def __init__(self, percent: int = PERCENT) -> None:
        bands, rows = bands_for(percent)
        self.bands = MinHash(bands, rows)
        self.more = MinHash(1, MINIMA - bands * rows, seed=6)

    def sign(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        first = self.bands.minima(sets)
        low = np.concatenate([first, self.more.minima(sets)], axis=1) & np.uint64((1 << BITS) - 1)
        return self.bands.band_keys(first), low.astype(np.uint8)


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes in runs of about ``RUN`` bytes, each with the place of its first text."""
    at, size, out = 0, 0, []
    for i, t in enumerate(texts):
        out.append((t.as_py() or "").encode("utf-8", "replace"))
        size += len(out[-1])
        if size >= RUN or len(out) >= 4096:
            yield at, out
            at, size, out = i + 1, 0, []
    if out:
        yield at, out


def signed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows doc_id, mark (hash of the text), n_shingles, digest of the set, band keys and signature (null without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(percent)
        for batch in batches:
            for at, texts in _runs(batch.column("text")):
                sets = [shingle_set(w) for w in batch_words(texts)]
                held = [i for i, s in enumerate(sets) if len(s)]
                keys, low = signer.sign([sets[i] for i in held]) if held else ([], [])
                place = dict(zip(held, range(len(held))))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(at, len(texts)) for c in ("doc_id", "row", "mark")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([keys[place[i]].tolist() if i in place else None for i in range(len(sets))], pa.list_(pa.int64())),
                    pa.array([low[place[i]].tobytes() if i in place else None for i in range(len(sets))], pa.binary()),
                ], names=["doc_id", "row", "mark", "n_shingles", "digest", "keys", "signature"])

    return docs.select("doc_id", "row", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, SIGNED)


def _sets(docs: DataFrame) -> DataFrame:
    """Shingle sets of the rows ``node``, ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _runs(batch.column("text")):
                yield pa.RecordBatch.from_arrays([
                    batch.column("node").slice(at, len(texts)),
                    pa.array([shingle_set(w).tobytes() for w in batch_words(texts)], pa.binary())], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles binary")


def links_of(nodes: list[int], left: list[bool], sets: list[np.ndarray], low: np.ndarray,
             percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links within one tile that join what was apart: pairs of a left and any other row that reach the threshold."""
    n = len(nodes)
    label = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    is_left = np.array(left)
    chance = 1.0 / (1 << BITS)
    least = least_estimate(percent)
    out = []
    for x in range(n):
        others = np.arange(x) if is_left[x] else np.flatnonzero(is_left[:x])
        others = others[(label[others] != label[x]) & (np.minimum(sizes[others], sizes[x]) * 100 >= percent * np.maximum(sizes[others], sizes[x]))]
        if not len(others):
            continue
        agree = (low[others] == low[x]).mean(1)
        estimate = (agree - chance) / (1 - chance)
        order = np.argsort(-estimate, kind="stable")
        for y in others[order[estimate[order] >= least]]:
            if label[y] == label[x]:
                continue
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * shared >= percent * (sizes[x] + sizes[y] - shared):
                label[label == label[y]] = label[x]
                out.append((nodes[x], nodes[y]))
    return out


def _tile_links(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links per tile; the rows of a tile follow one another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        now, rows = None, []

        def flush() -> pa.RecordBatch:
            found = links_of([r[0] for r in rows], [r[1] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows],
                             np.stack([np.frombuffer(r[3], np.uint8) for r in rows]), percent)
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], schema=schema)

        for batch in batches:
            columns = [batch.column(c) for c in ("bucket", "i", "j", "node", "at", "shingles", "signature")]
            for row in zip(*columns):
                bucket, i, j, node, at, shingles, signature = (v.as_py() for v in row)
                if (bucket, i, j) != now:
                    if len(rows) > 1:
                        yield flush()
                    now, rows = (bucket, i, j), []
                rows.append((node, at == i, shingles, signature))
        if len(rows) > 1:
            yield flush()

    return run


def buckets(classes: DataFrame) -> DataFrame:
    """Rows bucket, node, size of the buckets with two or more nodes; of buckets with equal members one is kept."""
    members = classes.select("node", F.explode("keys").alias("bucket"))
    held = cut(members.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("size > 1"))
    distinct = cut(held.groupBy("size", "low", "high", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size"))
    return cut(members.join(distinct, "bucket"))


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Exact links between classes that connect all that reach the threshold."""
    members = buckets(classes)
    wanted = cut(members.select("node").distinct().join(classes.select("node", "doc_id", "mark", "signature"), "node"))
    own = wanted.select("node", F.col("doc_id").alias("d"), F.col("mark").alias("m"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").join(
        own, (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d")))
    sets = _sets(texts).join(wanted.select("node", "signature"), "node")
    blocks = F.ceil(F.col("size") / BLOCK)
    tiles = members.withColumns({"blocks": blocks, "at": F.pmod(F.xxhash64("node"), blocks)})
    mine = F.col("at")
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "bucket", "node", mine.alias("at"), F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    rows = tiles.join(sets, "node")
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartition(width, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return ordered.select("bucket", "i", "j", "node", "at", "shingles", "signature").mapInArrow(_tile_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows row (a number), doc_id, mark (hash of the text), n_shingles, component_id, kept and ``group`` (a number).

    Words are separated by white space, A-Z count as a-z. A document with fewer words than a shingle has one shingle, one
    without words or text none, and is linked with nothing. ``component_id`` is the smallest id of the component; a row is
    kept if it has that id. Equal sets are one class from the start, so copies cost one row each. Rows that repeat an id
    are linked by their texts like any others; a null id is smaller than none, and a component without ids keeps its rows
    without one. Columns other than doc_id and text are not read; an empty table gives an empty one. ``percent`` is the
    least share of common shingles of a link.
    """
    rows = cut(signed(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), percent))
    first = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("r"))
    lead = cut(first.select("digest", F.col("r.row").alias("node")))
    classes = cut(lead.select(F.col("node").alias("row")).join(rows, "row").withColumnRenamed("row", "node"))
    parts = cut(components(links(docs, classes, percent)))
    tidy(docs)
    labels = cut(lead.join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("group")))
    named = rows.select("row", "doc_id", "mark", "n_shingles", "digest").join(labels, "digest", "left")
    named = cut(named.withColumn("group", F.coalesce("group", "row")).drop("digest"))
    least = cut(named.groupBy("group").agg(F.min("doc_id").alias("component_id")))
    return named.join(least, "group").select(
        "row", "doc_id", "mark", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "group")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def keep(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group of ``near_duplicates``; of rows that repeat the id that stays, one.

    Texts are found by id and hash. Rows equal in both, of which one must stay, take a path of their own, so that all other
    texts meet one semi join and no grouping. Documents without words are in no group and all stay, null texts too; of
    a group without any id one text stays. Other columns come through as they are, whatever their names; an empty table gives an empty one.
    """
    own = fresh(docs)
    kept = near_duplicates(docs, percent).where("kept").groupBy("group", "doc_id", "mark").agg(F.count("*").alias("n"))
    chosen = cut(kept.groupBy("group").agg(F.min(F.struct("mark", "n", "doc_id")).alias("c")).select(
        F.col("c.doc_id").alias(f"{own}id"), F.col("c.mark").alias(f"{own}mark"), F.col("c.n").alias(f"{own}n")))
    tidy(docs)

    def found(wanted: DataFrame) -> DataFrame:
        same = (F.xxhash64("text") == F.col(f"{own}mark")) & F.col("doc_id").eqNullSafe(F.col(f"{own}id"))
        return docs.join(wanted, same, "left_semi")

    once, more = found(chosen.where(f"{own}n = 1")), found(chosen.where(f"{own}n > 1"))
    return once.unionByName(more.dropDuplicates(["doc_id", "text"]))
