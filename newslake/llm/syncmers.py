"""Document fingerprints from closed syncmers, and the likeness of two fingerprints by positional matching.

A k-mer of characters is an anchor if its least inner s-mer (by hash) stands at its first or last place. Whether it does
depends on the k-mer alone, so equal passages get equal anchors wherever they stand, and every ``K - S`` neighbouring
k-mers hold one. Texts are framed by characters outside Unicode, so that short texts have anchors too.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import text_of
from newslake.llm.shingles import mix

K, S = 32, 8
#: Code of the frame around a text.
FRAME = 0x110000
#: Characters that are hashed at a time, and texts that wait for that.
PIECE = 1 << 19
#: Blocks of the order of documents per shuffle partition.
BLOCKS = 4
_STEP = 0x9E3779B97F4A7C15
_LAST = (1 << 64) - 1
ANCHOR = np.dtype([("gap", "u1"), ("hash", "<u4")])

RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all s-mers and k-mers of the codes, by doubling."""
    grams, width, by_width = mix(codes.astype(np.uint64) + np.uint64(_STEP)), 1, {}
    while width <= K:
        by_width[width] = grams
        grams = grams[:-width] * np.uint64(pow(_STEP, width, 1 << 64)) + grams[width:] if len(grams) > width else grams[:0]
        width *= 2
    return mix(by_width[S]), by_width[K]


def _selected(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the closed syncmers among the codes, and their hashes."""
    inner, outer = _grams(codes)
    framed = np.cumsum(np.concatenate([[0], codes == FRAME]))
    inner[framed[S:] - framed[:-S] == S] = _LAST  # an s-mer of the frame alone is never the least
    wide = K - S + 1
    low, width = inner, 1
    while width * 2 <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(low) - (wide - width)], low[wide - width:])
    at = np.flatnonzero((inner[:len(low)] == low) | (inner[wide - 1:] == low))
    return at, (mix(outer[at]) >> np.uint64(32)).astype(np.uint32)


def anchors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places (from 0, the frame included) and 32-bit hashes of each text's anchors; an empty text has none."""
    frame = np.full(K - 1, FRAME, dtype=np.uint32)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if waiting:
            starts = np.cumsum([0] + [len(c) for _, _, c in waiting])
            at, hashes = _selected(np.concatenate([c for _, _, c in waiting]))
            for (i, offset, codes), start, lo, hi in zip(
                    waiting, starts, np.searchsorted(at, starts[:-1]), np.searchsorted(at, starts[1:] - (K - 1))):
                found[i].append((at[lo:hi] - start + offset, hashes[lo:hi]))
        waiting.clear()
        size = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        codes = np.concatenate([frame, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), frame])
        for offset in range(0, len(codes) - (K - 1), PIECE):
            waiting.append((i, offset, codes[offset:offset + PIECE + K - 1]))
            size += len(waiting[-1][2])
            if size >= PIECE:
                flush()
    flush()
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32))
    return [tuple(np.concatenate(part) for part in zip(*parts)) if parts else none for parts in found]


def written(places: np.ndarray, hashes: np.ndarray) -> str:
    """The fingerprint as text: base64 of (distance to the anchor before, hash); distances stay below ``K``."""
    out = np.zeros(len(places), dtype=ANCHOR)
    out["gap"], out["hash"] = np.diff(places, prepend=-1), hashes
    return base64.b64encode(out.tobytes()).decode()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(base64.b64decode(fingerprint), dtype=ANCHOR)
    return np.cumsum(rows["gap"].astype(np.int64)) - 1, rows["hash"]


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that tell the first, second… anchor of one hash apart, sorted, and the anchors' numbers."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.searchsorted(ordered, ordered)
    return (ordered.astype(np.uint64) << np.uint64(32)) | (np.arange(len(order)) - first).astype(np.uint64), order


def _rising(places: np.ndarray) -> int:
    """Length of the longest rising subsequence."""
    if len(places) < 2 or (np.diff(places) > 0).all():
        return len(places)
    ends: list[int] = []
    for p in places.tolist():
        at = bisect_left(ends, p)
        if at == len(ends):
            ends.append(p)
        else:
            ends[at] = p
    return len(ends)


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Twice the anchors that match in the same order, by the number of both; 1 for equal and 0 for unlike fingerprints.

    The first anchor of a hash can match the first of that hash in the other text, the second the second and so on, so
    repeated lines cost no pairs; of these matches the longest chain counts that rises in both texts.
    """
    if not len(one[0]) and not len(other[0]):
        return 1.0
    left, left_at = _numbered(one[1])
    right, right_at = _numbered(other[1])
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    a, b = left_at[i], right_at[j]
    chain = _rising(b[np.argsort(a, kind="stable")])
    return 2.0 * chain / (len(one[0]) + len(other[0]))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first characters of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _judged(rows: list[tuple]) -> pa.RecordBatch | None:
    """Results of the rows (block, guest, id, text) that a row of their block follows."""
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(rows, rows[1:])) if a[0] == b[0] and not a[1]]
    if not pairs:
        return None
    marks = anchors([r[3] for r in rows])
    changed = [edited(a[3], b[3]) for _, a, b in pairs]
    out: list[tuple] = []
    for (i, a, _), text, mark in zip(pairs, changed, anchors(changed)):
        out.append((a[2], len(a[3]), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), written(*marks[i]), written(*mark),
                    likeness(marks[i], mark), likeness(marks[i], marks[i + 1])))
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "guest", "doc_id"))):
            held.append(row)
        at = len(held) - batch.num_rows
        for k, text in enumerate(batch.column("text")):
            held[at + k] = (*held[at + k], text.as_py())
            size += len(held[at + k][3])
            if size >= PIECE or k + 1 == batch.num_rows:
                done = _judged(held[:at + k + 1])
                if done is not None:
                    yield done
                held = held[at + k:]
                at, size = -k, len(held[0][3])


def _bounds(keys: DataFrame, blocks: int) -> list[int]:
    """Least key of each block of the order; at most ``blocks`` numbers, whatever the input's size."""
    parts = keys.repartitionByRange(blocks, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("least"))
    return sorted(r.least for r in parts.collect())


def _blocks_of(bounds: list[int]) -> Column:
    edges = np.array(bounds)

    @F.pandas_udf("array<int>")
    def blocks(key: pd.Series) -> pd.Series:
        block = np.searchsorted(edges, key.to_numpy(), side="right") - 1
        first = edges[block] == key.to_numpy()
        return pd.Series([[int(b), int(b - 1) % len(edges)] if f else [int(b)] for b, f in zip(block, first)])

    return blocks("key")


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are to each other and to the next document's.

    Rows doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Documents
    follow each other by doc_id (null first), then text; repeated rows are documents of their own; after the last comes
    the first, so a lone document follows itself. A null text counts as empty; the fingerprint of an empty text is empty,
    and two empty ones are alike. An empty table gives an empty one; other columns are not read.

    One shuffle: ids alone are sampled for the bounds of blocks of the order, texts go to their block once, and the first
    row of a block also goes to the block before as a guest. A task reads its blocks in order and holds ``PIECE`` characters,
    or one text and the next.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    blocks = BLOCKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(keyed.select("key"), blocks)
    if not bounds:
        return docs.sparkSession.createDataFrame([], RESULT)
    dealt = keyed.select("doc_id", "text", "key", F.posexplode(_blocks_of(bounds)).alias("guest", "block"))
    ordered = dealt.repartition("block").sortWithinPartitions("block", "guest", "key", "text")
    return ordered.select("block", "guest", "doc_id", "text").mapInArrow(_stream, RESULT)
