"""Hard-negative mining: clusters of anchors share candidate lists sorted once by an angular upper bound.

For a cluster with centre c and widest member angle b, no member q scores more than |q| |v| cos(max(0, angle(c, v) - b)) with
a candidate v. Candidates are dealt into shards; each shard is sorted once per cluster by that bound (without |q|), and every
member walks the list until its own bound falls below what it still needs, which certifies that nothing better follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslake.llm.common import cut

SCALE = 256.0
ANCHOR_STEP, RELABEL_STEP, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: A negative scores between this share (in percent) and all of its positive's score.
LEAST_PERCENT = 80
#: Rows of a shard, members of a cluster's block about, and blocks that meet a shard in one task.
SHARD, MEMBERS, SLAB = 4096, 128, 16
#: Anchors that the centres are fitted on at most, centres at most, and rounds of fitting.
SAMPLE, CENTRES, ROUNDS = 8192, 128, 6
#: Candidates that are scored at a time.
STEP = 256
#: Integer sums below this are exact in a double.
EXACT = float(1 << 53)
_NONE = -(1 << 63)

PACKED = "shard long, ids binary, labels binary, vectors binary, dims int"
ANCHORS = "row long, vec_id long, label long, vector binary"
BLOCKS = "block long, rows binary, ids binary, labels binary, vectors binary, dims int, wants binary"
FOUND = "row long, wanted int, score long, vec_id long"


def taking_part(vectors: DataFrame) -> DataFrame:
    """Rows with an id, a label and a finite vector, relabelled, with floored components as doubles."""
    vector = F.col("embedding").cast("array<double>")
    label = F.col("label").cast("long")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select(
        "vec_id", F.when(F.col("vec_id") % RELABEL_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label"), "embedding")


def _matrix(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    dims = int(frame["embedding"].map(len).max())
    matrix = np.floor(SCALE * _matrix(frame["embedding"].tolist(), dims))
    return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
                         "labels": [frame["label"].to_numpy(np.int64).tobytes()], "vectors": [matrix.tobytes()], "dims": [dims]})


def _unpack(vectors: bytes, own: int, rows: int, dims: int) -> np.ndarray:
    out = np.zeros((rows, dims))
    out[:, :own] = np.frombuffer(vectors, np.float64).reshape(rows, own)
    return out


def shards_of(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows packed into shards of about ``SHARD``, dealt by a hash of their place, so that no key of the data does it."""
    count = max(1, -(-rows.count() // SHARD))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)))
    return cut(dealt.groupBy("shard").applyInPandas(_pack, PACKED)), count


def anchors_of(shards: DataFrame, step: int) -> DataFrame:
    """The anchors among packed rows; ``row`` numbers a row by shard and place, so repeated ids stay apart."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples():
                ids, labels = np.frombuffer(t.ids, np.int64), np.frombuffer(t.labels, np.int64)
                at = np.flatnonzero(ids % step == 0)
                matrix = _unpack(t.vectors, t.dims, len(ids), t.dims)
                yield pd.DataFrame({"row": (t.shard << 32) + at, "vec_id": ids[at], "label": labels[at],
                                    "vector": [matrix[i].tobytes() for i in at]})
    return shards.mapInPandas(run, ANCHORS)


def _directions(vectors: list[bytes], dims: int) -> np.ndarray:
    matrix = _matrix([np.frombuffer(v, np.float64) for v in vectors], dims)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def centres_of(anchors: DataFrame, count: int) -> np.ndarray:
    """Spherical k-means over at most ``SAMPLE`` anchors, chosen by hash; only how far lists are walked depends on it."""
    sample = anchors.orderBy(F.xxhash64("vector", "row"), "row").limit(SAMPLE).select("vector").collect()
    dims = max((len(r.vector) // 8 for r in sample), default=0)
    points = _directions([r.vector for r in sample], dims)
    centres = points[:max(1, min(CENTRES, count // MEMBERS, len(points)))]
    for _ in range(ROUNDS):
        near = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def clustered(anchors: DataFrame) -> tuple[DataFrame, int]:
    """The anchors with ``block``: their cluster, large clusters split by a hash of the row."""
    count = anchors.count()
    if not count:
        return anchors.withColumn("block", F.lit(0).cast("long")), 0
    centres = centres_of(anchors, count)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            dims = max([centres.shape[1], *(len(v) // 8 for v in frame["vector"])])
            points = _directions(frame["vector"].tolist(), dims)[:, :centres.shape[1]]
            frame["cluster"] = (points @ centres.T).argmax(axis=1) if len(frame) else np.zeros(0, dtype=np.int64)
            yield frame

    placed = anchors.mapInPandas(run, f"{ANCHORS}, cluster long")
    sizes = {r["cluster"]: r["n"] for r in placed.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    first, starts, parts = 0, [], []
    for c in range(len(centres)):
        starts.append(first)
        parts.append(max(1, -(-sizes.get(c, 0) // MEMBERS)))
        first += parts[-1]
    at = (F.col("cluster") + 1).cast("int")
    start, part = (F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), at) for values in (starts, parts))
    return cut(placed.withColumn("block", start + F.pmod(F.xxhash64("row"), part)).drop("cluster")), first


def _gather(frame: pd.DataFrame) -> pd.DataFrame:
    dims = max(len(v) // 8 for v in frame["vector"])
    matrix = _matrix([np.frombuffer(v, np.float64) for v in frame["vector"]], dims)
    wants = [np.asarray(w, dtype=np.int64) for w in frame["wants"]]
    return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "rows": [frame["row"].to_numpy(np.int64).tobytes()],
                         "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "labels": [frame["label"].to_numpy(np.int64).tobytes()],
                         "vectors": [matrix.tobytes()], "dims": [dims],
                         "wants": [np.array([np.pad(w, (0, POSITIVES - len(w)), constant_values=_NONE) for w in wants]).tobytes()]})


def angular_bounds(members: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Per candidate the most that any member of unit length can score with it."""
    norms = np.linalg.norm(candidates, axis=1)
    lengths = np.linalg.norm(members, axis=1)
    units = members[lengths > 0] / lengths[lengths > 0, None]
    centre = units.sum(axis=0)
    size = np.linalg.norm(centre)
    if size < 1e-9:
        return norms
    centre /= size
    widest = np.arccos(np.clip(units @ centre, -1, 1)).max() + 1e-6
    cosines = np.divide(candidates @ centre, norms, out=np.ones_like(norms), where=norms > 0)
    return norms * np.cos(np.maximum(0.0, np.arccos(np.clip(cosines, -1, 1)) - widest))


class Walk:
    """One shard's list for one block of members, sorted once by the bound."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, members: np.ndarray, shard: int, ids: np.ndarray, own_labels: np.ndarray,
                 candidates: np.ndarray) -> None:
        bounds = angular_bounds(members, candidates)
        order = np.lexsort((ids, -bounds))
        self.bounds, self.ids, self.labels, self.candidates = bounds[order], ids[order], own_labels[order], candidates[order]
        self.numbers = (shard << 32) + order
        self.rows, self.member_labels, self.members = rows, labels, members
        self.lengths = np.linalg.norm(members, axis=1)
        self.slack = 1e-6 + 1e-9 * self.lengths * (np.linalg.norm(candidates, axis=1).max() if len(candidates) else 0.0)
        self.exact = not members.size or not candidates.size or np.abs(members).sum(1).max() * np.abs(candidates).max() < EXACT

    def scores(self, at: int, active: np.ndarray) -> np.ndarray:
        part = self.candidates[at:at + STEP]
        if self.exact:
            return (self.members[active] @ part.T).astype(np.int64)
        rows = [[sum(int(a) * int(b) for a, b in zip(q, c)) for c in part] for q in self.members[active]]
        if any(abs(s) >= 1 << 63 for row in rows for s in row):
            raise ValueError("an inner product does not fit a long")
        return np.array(rows, dtype=np.int64).reshape(len(active), len(part))

    def run(self, lists: list[list[list]], same_label: bool, keep: int) -> None:
        """Fill the lists [least, most, found] of every member, each until no later candidate can enter."""
        needs = [min((self._need(w, keep) for w in mine), default=math.inf) for mine in lists]
        active = [j for j, need in enumerate(needs) if need < math.inf]
        for at in range(0, len(self.bounds), STEP):
            active = [j for j in active if self.lengths[j] * self.bounds[at] + self.slack[j] >= needs[j]]
            if not active:
                return
            scores = self.scores(at, np.array(active))
            ids, numbers = self.ids[at:at + STEP], self.numbers[at:at + STEP]
            for j, row in zip(active, scores):
                fits = (self.labels[at:at + STEP] == self.member_labels[j]) == same_label
                fits &= numbers != self.rows[j]
                for want in lists[j]:
                    need = self._need(want, keep)
                    if need == math.inf:
                        continue
                    pick = np.flatnonzero(fits & (row <= want[1]) & (row >= need))
                    if len(pick):
                        pick = pick[np.lexsort((ids[pick], -row[pick]))[:keep]]
                        want[2] = sorted(want[2] + [(-int(row[i]), int(ids[i])) for i in pick])[:keep]
                needs[j] = min((self._need(w, keep) for w in lists[j]), default=math.inf)

    @staticmethod
    def _need(want: list, keep: int) -> float | int:
        """Least score that can still enter a list; ties may enter by a smaller id."""
        least, most, found = want
        if least > most:
            return math.inf
        return max(least, -found[-1][0]) if len(found) == keep else least


def least_negative(positive: int) -> int:
    """Smallest integer n with LEAST_PERCENT * positive <= 100 * n."""
    return -(-LEAST_PERCENT * positive // 100)


def _tiles(same_label: bool, keep: int):
    """Walk the shards of a task for each of its member blocks."""
    def run(members: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        for s in shards.itertuples():
            ids, own_labels = np.frombuffer(s.ids, np.int64), np.frombuffer(s.labels, np.int64)
            for m in members.itertuples():
                dims = max(m.dims, s.dims)
                rows, labels = np.frombuffer(m.rows, np.int64), np.frombuffer(m.labels, np.int64)
                walk = Walk(rows, labels, _unpack(m.vectors, m.dims, len(rows), dims), s.shard, ids, own_labels,
                            _unpack(s.vectors, s.dims, len(ids), dims))
                wants = np.frombuffer(m.wants, np.int64).reshape(len(rows), POSITIVES).tolist()
                if same_label:
                    lists = [[[w[0], (1 << 63) - 1, []]] for w in wants]
                else:
                    lists = [[[least_negative(p), p, []] if p != _NONE else [1, 0, []] for p in w] for w in wants]
                walk.run(lists, same_label, keep)
                out += [(int(r), k, -s_, v) for r, mine in zip(rows, lists) for k, want in enumerate(mine) for s_, v in want[2]]
        return pd.DataFrame(out, columns=["row", "wanted", "score", "vec_id"]).astype({"row": "int64", "wanted": "int32", "score": "int64", "vec_id": "int64"})
    return run


def _walked(members: DataFrame, shards: DataFrame, same_label: bool, keep: int, blocks: int, count: int, only_own: bool = False) -> DataFrame:
    """The best of all walks, ranked from 1: row, wanted, rank, score, vec_id."""
    packed = members.groupBy("block").applyInPandas(_gather, BLOCKS).withColumn("slab", F.floor(F.col("block") / SLAB))
    slabs = -(-blocks // SLAB)
    seed = F.pmod(F.xxhash64("slab"), F.lit(count))
    left = packed.withColumn("shard", seed) if only_own else packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    right = shards.withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))))
    if only_own:
        right = right.where(F.col("shard") == seed)
    found = left.groupBy("shard", "slab").cogroup(right.groupBy("shard", "slab")).applyInPandas(_tiles(same_label, keep), FOUND)
    best = Window.partitionBy("row", "wanted").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def mine(vectors: DataFrame, step: int = ANCHOR_STEP) -> DataFrame:
    """Per anchor (vec_id divisible by ``step``) and positive the hardest negatives: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. An empty vector scores 0 with
    all; a shorter one counts as padded with zeros. Rows that repeat an id are rows of their own, as anchors, positives and
    negatives; ties go to the smaller id. Anchors without positives, or positives without negatives in range, give no rows.
    An inner product beyond a long is an error. Other columns are not read.

    Every member block meets every shard in a task of ``SLAB`` blocks and one shard, so a task is bounded and nothing is
    broadcast. Positives are first sought in one shard per slab; the score that the last of five reaches there ends the
    walks through all shards early.
    """
    shards, count = shards_of(taking_part(vectors))
    members, blocks = clustered(anchors_of(shards, step))
    if not blocks:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    none = F.array().cast("array<long>")
    first = _walked(members.withColumn("wants", none), shards, True, POSITIVES, blocks, count, only_own=True)
    floors = first.where(F.col("rank") == POSITIVES).select("row", F.array("score").alias("wants"))
    seeded = members.join(floors, "row", "left").withColumn("wants", F.coalesce("wants", none))
    positives = cut(_walked(seeded, shards, True, POSITIVES, blocks, count).select(
        "row", (F.col("rank") - 1).alias("wanted"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")))
    wants = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("wanted", "positive_score")))["positive_score"].alias("wants"))
    negatives = _walked(members.join(wants, "row"), shards, False, NEGATIVES, blocks, count)
    named = negatives.join(positives, ["row", "wanted"]).join(members.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score"))


def sql() -> str:
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id,
    CASE WHEN vec_id % {RELABEL_STEP} = 0 THEN (CAST(label AS BIGINT) + 1) % {LABELS} ELSE CAST(label AS BIGINT) END AS label,
    CAST(list_transform(embedding, lambda x: floor({int(SCALE)} * CAST(x AS DOUBLE))) AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % {ANCHOR_STEP} = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND {LEAST_PERCENT} * p.score <= 100 * s.score AND s.score <= p.score WHERE p.k <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
