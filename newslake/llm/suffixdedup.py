"""Removal of byte strings that occur more than once, by refinement of buckets of suffixes.

Every start of a string of ``LENGTH`` bytes belongs to an anchor, the least q-gram of the string; equal strings have their
anchors at equal offsets. Anchors with equal q-grams form the initial buckets. A bucket is refined by identifiers (hashes) of
the bytes around later offsets, first for whole runs of starts that share an anchor, then for blocks of starts, then for
single starts. What one refinement settles is used for all starts of the run or block: equal surroundings settle all as
repeated, a bucket of one as unrepeated. Only the rest is split, and of equal members one stands for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.anchors import LENGTH, PIECE, SPAN, Piece, runs
from newslake.llm.common import cut, fresh, same_columns, text_of, tidy
from newslake.llm.shingles import mix

#: Starts of a block; single starts follow.
BLOCK = 16
#: Parts of a bucket whose members are judged in tasks of their own: one bit of a long each.
PARTS = 64
#: Bytes of texts that are scanned together.
RUN = 1 << 22

_EXTRA = 17
_OCCURRENCE = "bucket long, whole long, key long, place long"
_SUMMARY = "bucket long, whole long, least long, most long"


def _place(anchor: np.ndarray, high: np.ndarray, low: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Anchor (31 bits), its distance from the first and the last start (8 bits each) and more bits of the text's hash."""
    return ((anchor.astype(np.int64) << 33) | (high.astype(np.int64) << 25) | (low.astype(np.int64) << 17) | extra.astype(np.int64))


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 33, (place >> 25) & 255, (place >> 17) & 255


def _ident(key, place):
    """One number for an occurrence, alike in numpy and as a column: keys are hashes, so others meet it by chance only."""
    return key.bitwiseXOR(place) if isinstance(key, Column) else key ^ place


def _rows(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _summary(bucket: np.ndarray, whole: np.ndarray, ident: np.ndarray) -> pa.RecordBatch:
    """Least and most identity per (bucket, whole) of one batch."""
    order = np.lexsort((ident, whole, bucket))
    bucket, whole, ident = bucket[order], whole[order], ident[order]
    first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (whole[1:] != whole[:-1])])) if len(bucket) else np.zeros(0, int)
    last = np.append(first[1:], len(bucket)) - 1 if len(first) else first
    return _rows(_SUMMARY, bucket[first], whole[first], ident[first], ident[last])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    at, size, out = 0, 0, []
    for i, t in enumerate(batch.column("text")):
        out.append(t.as_py())
        size += len(out[-1])
        if size >= RUN:
            yield at, out
            at, size, out = i + 1, 0, []
    if out:
        yield at, out


def _scan(summary: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of all texts: (gram, hash of the run's bytes, key, place), or their summary per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, extras = (batch.column(c).to_numpy() for c in ("key", "extra"))
            for at, texts in _texts(batch):
                for piece, r in runs(texts):
                    key, extra = keys[at + r["text"]], extras[at + r["text"]]
                    high, low = r["anchor"] - r["first"], r["anchor"] - r["last"]
                    whole = mix(piece.hashes(r["first"], r["last"] + LENGTH) + (high * 256 + low).astype(np.uint64)).view(np.int64)
                    place = _place(r["anchor"] + r["shift"], high, low, extra)
                    gram = r["gram"].view(np.int64)
                    yield _summary(gram, whole, _ident(key, place)) if summary else _rows(_OCCURRENCE, gram, whole, key, place)
    return run


def _blocks(summary: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the runs' starts: the bucket is the hash of the bytes that all strings of the block share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            key, place, piece, at = _around(batch)
            anchor, high, low = _unpack(place)
            a = at + high
            columns: list[tuple[np.ndarray, ...]] = []
            for b in range(0, SPAN, BLOCK):
                e = min(b + BLOCK, SPAN) - 1
                lo, hi = np.maximum(low, b), np.minimum(high, e)
                # Bytes that the strings of the whole block share lie within every string, whichever starts the run owns.
                held = np.flatnonzero(lo <= hi)
                k, lo, hi = a[held], lo[held], hi[held]
                bucket = mix(piece.hashes(k - b, k - e + LENGTH) + np.uint64(b))
                whole = mix(piece.hashes(k - hi, k - lo + LENGTH) + (hi * 256 + lo).astype(np.uint64))
                columns.append((bucket.view(np.int64), whole.view(np.int64), key[held],
                                _place(anchor[held], hi, lo, place[held] & ((1 << _EXTRA) - 1)), place[held]))
            bucket, whole, keys, places, runs_ = (np.concatenate(c) for c in zip(*columns))
            if summary:
                yield _summary(bucket, whole, _ident(keys, places))
            else:
                yield _rows(_OCCURRENCE + ", run long", bucket, whole, keys, places, runs_)
    return run


def _slices(batches: Iterator[pa.RecordBatch], rows: int = PIECE // (LENGTH + SPAN)) -> Iterator[pa.RecordBatch]:
    """Parts of batches whose surroundings fit into one piece."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _around(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Piece, np.ndarray]:
    """Keys and places of a batch of surroundings, their bytes joined, and where each begins."""
    parts = [t.as_py() for t in batch.column("around")]
    at = np.cumsum([0] + [len(p) for p in parts])[:-1]
    return batch.column("key").to_numpy(), batch.column("place").to_numpy(), Piece(b"".join(parts)), at


def _singles(summary: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Single starts of the listed blocks: bucket (gram) and hash of the string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            key, place, piece, at = _around(batch)
            anchor, high, _ = _unpack(place)
            gram = batch.column("bucket").to_numpy()
            rows, offsets = [], []
            for i, blocks in enumerate(batch.column("blocks")):
                for block in blocks.as_py():
                    hi, lo = (block >> 25) & 255, (block >> 17) & 255
                    offsets.append(np.arange(lo, hi + 1))
                    rows.append(np.full(hi - lo + 1, i))
            i, d = np.concatenate(rows), np.concatenate(offsets)
            start = at[i] + high[i] - d
            whole = piece.hashes(start, start + LENGTH).view(np.int64)
            places = _place(anchor[i], d, d, place[i] & ((1 << _EXTRA) - 1))
            yield _summary(gram[i], whole, _ident(key[i], places)) if summary else _rows(_OCCURRENCE, gram[i], whole, key[i], places)
    return run


def _settle(summaries: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Occurrences in buckets of two or more, with ``repeated`` and ``split`` (goes on to the next refinement).

    Summaries are partial: a key of any weight sends a row per batch. A bucket is dealt in ``PARTS`` parts by its members'
    hashes; what holds for all of it is a partial aggregate of one row, sent back to the parts that it has, so no bucket
    meets in one task. The occurrences of a heavy key meet one row of the status table, in a join that may split them.
    Only the status of such buckets is written.
    """
    width = max(1, int(summaries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.col("whole").bitwiseAND(PARTS - 1).cast("int")
    each = summaries.withColumn("part", part).repartition(width, "bucket", "part").groupBy("bucket", "part", "whole").agg(
        F.min("least").alias("least"), F.max("most").alias("most"))
    each = cut(each.select("bucket", "part", "whole", "least", (F.col("least") != F.col("most")).alias("repeated")))  # texts are scanned once for it
    tidy(summaries)
    buckets = each.groupBy(F.col("bucket").alias("b")).agg(
        F.count("*").alias("n"), F.bool_and("repeated").alias("all"), F.bool_or("repeated").alias("any"),
        F.bit_or(F.expr("shiftleft(1L, part)")).alias("parts")).where("n > 1 OR any")
    held = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.getbit("parts", p) == 1)
    buckets = buckets.select("b", (~F.col("all") & (F.col("n") > 1)).alias("mixed"), F.explode(held).alias("p"))
    status = each.join(buckets, (F.col("bucket") == F.col("b")) & (F.col("part") == F.col("p"))).drop("b")
    status = cut(status.select(F.col("bucket").alias("b"), F.col("whole").alias("w"), "least", "repeated", "mixed"))
    joined = occurrences.join(status, (F.col("bucket") == F.col("b")) & (F.col("whole") == F.col("w")))
    lead = _ident(F.col("key"), F.col("place")) == F.col("least")
    return joined.withColumn("split", F.col("mixed") & (~F.col("repeated") | lead)).drop("b", "w", "whole", "least", "mixed")


def _class(t: Column) -> tuple[Column, Column]:
    """Key and extra, both hashes of a text; equal texts are one class."""
    return F.xxhash64(t), F.xxhash64(F.lit(1), t).bitwiseAND((1 << _EXTRA) - 1)


def _named(docs: DataFrame) -> DataFrame:
    """The documents with key and extra, for frames without columns of a caller."""
    key, extra = _class(text_of())
    return docs.withColumns({"key": key, "extra": extra})


def _with_text(docs: DataFrame, lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Lists by (key, extra) joined with one text of each class; only texts with a list go on."""
    chosen = cut(lists.join(classes, ["key", "extra"]).withColumnsRenamed({"key": "k", "extra": "x"}))
    texts = _named(docs.select("doc_id", text_of().alias("text")))
    return texts.join(chosen, (F.col("key") == F.col("k")) & (F.col("extra") == F.col("x")) & F.col("doc_id").eqNullSafe(F.col("lead")))


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes from a run's first start to the end of its last string."""
    for batch in batches:
        key, out = batch.column("key"), []
        for i, (text, rows) in enumerate(zip(batch.column("text"), batch.column("rows"))):
            raw = text.as_py().encode("utf-8", "replace")
            for row in rows.as_py():
                place = row["place"]
                anchor = place >> 33
                out.append((row["bucket"], key[i].as_py(), place, raw[anchor - ((place >> 25) & 255):anchor - ((place >> 17) & 255) + LENGTH]))
            if len(out) >= 1 << 13:
                yield _around_rows(out)
                out = []
        if out:
            yield _around_rows(out)


def _around_rows(out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    bucket, key, place, around = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(key, pa.int64()), pa.array(place, pa.int64()),
                                       pa.array(around, pa.binary())], names=["bucket", "key", "place", "around"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class the removed bytes, the number of their runs, and the rest."""
    for batch in batches:
        out = []
        for text, places in zip(batch.column("text"), batch.column("places")):
            raw = text.as_py().encode("utf-8", "replace")
            anchor, high, low = _unpack(places.values.to_numpy())
            edge = np.zeros(len(raw) + 1, dtype=np.int32)
            np.add.at(edge, anchor - high, 1)
            np.add.at(edge, anchor - low + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            rest = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
            out.append((int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(rest).hexdigest(), rest))
        n, spans, sha, rest = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([
            batch.column("key"), batch.column("extra"), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()),
            pa.array(rest, pa.binary())], names=["key", "extra", "n_removed", "n_spans", "kept_sha256", "rest"])


def _covered(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Places of runs, blocks and starts whose strings are repeated: key, extra, places (an array)."""
    extra = F.col("place").bitwiseAND((1 << _EXTRA) - 1).alias("extra")
    repeated = F.collect_set(F.when(F.col("repeated"), F.col("place"))).alias("places")
    texts = _named(docs.select(text_of().alias("text"))).where(F.octet_length("text") >= LENGTH).select(
        "key", "extra", F.col("text").cast("binary").alias("text"))
    first = cut(_settle(texts.mapInArrow(_scan(True), _SUMMARY), texts.mapInArrow(_scan(False), _OCCURRENCE)).groupBy("key", extra).agg(
        repeated, F.collect_set(F.when(F.col("split"), F.struct("bucket", "place"))).alias("rows")))
    tidy(docs)
    around = cut(_with_text(docs, first.where(F.size("rows") > 0).select("key", "extra", "rows"), classes).select("key", "text", "rows").mapInArrow(
        _surroundings, "bucket long, key long, place long, around binary"))
    first = first.select("key", "extra", "places")
    tidy(docs)
    second = cut(_settle(around.mapInArrow(_blocks(True), _SUMMARY), around.mapInArrow(_blocks(False), _OCCURRENCE + ", run long")).groupBy(
        "key", "run").agg(repeated, F.collect_set(F.when(F.col("split"), F.col("place"))).alias("blocks")))
    tidy(docs)
    blocks = second.where(F.size("blocks") > 0).select(F.col("key").alias("k"), F.col("run").alias("r"), "blocks")
    listed = cut(around.join(blocks, (F.col("key") == F.col("k")) & (F.col("place") == F.col("r"))).select(
        "bucket", "key", "place", "around", "blocks"))
    del around, blocks
    tidy(docs)
    third = cut(_settle(listed.mapInArrow(_singles(True), _SUMMARY), listed.mapInArrow(_singles(False), _OCCURRENCE)).where("repeated").groupBy(
        "key", extra).agg(repeated))
    del listed
    tidy(docs)
    of_run = F.col("run").bitwiseAND((1 << _EXTRA) - 1).alias("extra")
    return first.where(F.size("places") > 0).union(second.where(F.size("places") > 0).select("key", of_run, "places")).union(third)


def removal(docs: DataFrame, texts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What becomes of each class of equal texts (key, extra): its fate, its rest, and the documents' classes.

    The first table has n_removed, n_spans and kept_sha256 (null where nothing is removed); the second, with ``texts``, has
    ``rest`` of the classes that change. A text of ``LENGTH`` bytes or more that has a copy goes as a whole.
    """
    t = text_of()
    slim = cut(_named(docs.select("doc_id", "text")).select(
        "doc_id", "key", "extra", F.octet_length(t).cast("bigint").alias("n_bytes"), F.sha2(t, 256).alias("sha")))
    classes = cut(slim.groupBy("key", "extra").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("lead"), F.first("n_bytes").alias("n_bytes")))
    covered = _covered(docs, classes)
    lists = covered.groupBy("key", "extra").agg(F.flatten(F.collect_list("places")).alias("places"))
    alone = classes.where("copies = 1").drop("n_bytes", "copies")
    removed = _with_text(docs, lists, alone).select("key", "extra", "text", "places").mapInArrow(
        _removed, "key long, extra long, n_removed long, n_spans long, kept_sha256 string, rest binary")
    removed = cut(removed if texts else removed.drop("rest"))
    tidy(docs)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    none = hashlib.sha256(b"").hexdigest()
    judged = cut(classes.drop("lead").join(removed.select("key", "extra", "n_removed", "n_spans", "kept_sha256"), ["key", "extra"], "left").select(
        "key", "extra", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.lit(none)).otherwise(F.col("kept_sha256")).alias("kept_sha256")))
    gone = classes.where(whole).select("key", "extra", F.lit(b"").alias("rest"))
    rest = removed.select("key", "extra", "rest").union(gone) if texts else gone
    return judged, rest, slim


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty. Texts under ``LENGTH`` bytes lose nothing. Repeated rows are copies of each other, whatever
    their ids; null ids are ids. Other columns are not read; an empty table gives an empty one.
    """
    judged, _, slim = removal(docs)
    return slim.join(judged, ["key", "extra"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def stripped(docs: DataFrame) -> DataFrame:
    """The documents without the removed bytes; parts of characters that a cut leaves become U+FFFD.

    All rows stay, also those whose text becomes empty; a null text stays null; repeated rows of ``LENGTH`` bytes or more
    become empty. Other columns come through as they are, whatever their names; an empty table gives an empty one.
    """
    _, rest, _ = removal(docs, texts=True)
    own = fresh(docs)
    changed = rest.select(F.col("key").alias(f"{own}key"), F.col("extra").alias(f"{own}extra"), F.col("rest").alias(f"{own}rest"))
    key, extra = _class(text_of())
    joined = docs.join(changed, (key == F.col(f"{own}key")) & (extra == F.col(f"{own}extra")), "left")
    rest_text = F.call_function("make_valid_utf8", F.col(f"{own}rest").cast("string"))
    return joined.withColumn("text", F.when(F.col(f"{own}rest").isNull(), F.col("text")).otherwise(rest_text)).select(*same_columns(docs))
