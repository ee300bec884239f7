"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslake.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute_mine(rows, step=100):
    kept = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    for i, (anchor, label, q) in enumerate(kept):
        if anchor % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), d, other == label) for j, (d, other, v) in enumerate(kept) if j != i)
        for p, positive, _ in [s for s in scored if s[2]][:5]:
            fits = [(-s, d) for s, d, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(anchor, positive, rank, d, -p, s) for rank, (s, d) in enumerate(fits[:5], 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in hardneg.mine(df, **kw).collect())


@pytest.fixture
def small(monkeypatch):
    """Small shards, blocks and steps, so that few rows take every way."""
    for name, value in (("SHARD", 40), ("MEMBERS", 4), ("SLAB", 2), ("STEP", 8)):
        monkeypatch.setattr(hardneg, name, value)


def vectors(rng, n, dims=6):
    base = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, rng.randrange(3), [x + rng.gauss(0, 0.3) for x in rng.choice(base)]) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_random_vectors(spark, checkpoints, small, seed):
    rows = vectors(random.Random(seed), 400)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(4), step=10) == brute_mine(rows, 10) != []


def test_odd_vectors(spark, checkpoints, small):
    """Nulls, empty and short vectors, repeated ids and rows, ties, negative scores, and a vector that a third of the rows hold."""
    rows = vectors(random.Random(5), 60)
    rows += [(100, 1, [1.0, 1.0]), (100, 1, [1.0, 1.0]), (100, 2, [-1.0, 0.5]), (200, None, [1.0]), (300, 1, None), (None, 1, [1.0]), (400, 1, [1.0, None]),
             (500, 1, [float("nan")]), (600, 1, [float("inf")]), (700, 9, []), (701, 0, []), (702, 0, [0.0] * 6), (800, 1, [-3.0] * 6)]
    rows += [(900 + i, i % 3, [0.5] * 6) for i in range(40)]
    clash = {c: F.lit("mine") for c in ("row", "shard", "block", "slab", "rank", "score", "wants", "ids")}
    assert mined(spark.createDataFrame(rows, SCHEMA).withColumns(clash)) == brute_mine(rows) != []


def test_no_rows_and_no_anchors(spark, checkpoints):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty) == [] and hardneg.mine(empty).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0])], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, 1, [1.0])], SCHEMA)) == []


def test_bounds_are_upper_bounds():
    rng = np.random.default_rng(1)
    for spread in (0.01, 0.3, 3.0):
        members = np.floor(256 * (np.ones(8) + spread * rng.normal(size=(30, 8))))
        members[3] = 0
        candidates = np.floor(256 * rng.normal(size=(200, 8)))
        candidates[7] = 0
        most = hardneg.angular_bounds(members, candidates)
        scores = members @ candidates.T
        assert (scores <= np.linalg.norm(members, axis=1)[:, None] * most + 1e-3).all()


def test_walks_end_early():
    """Members near each other leave most of a spread-out list unread."""
    rng = np.random.default_rng(2)
    members = np.floor(256 * (np.eye(8)[0] + 0.02 * rng.normal(size=(10, 8))))
    candidates = np.floor(256 * rng.normal(size=(5000, 8)))
    walk = hardneg.Walk(np.arange(10) + (9 << 32), np.zeros(10), members, 0, np.arange(5000), np.zeros(5000), candidates)
    read = []
    scores = walk.scores
    walk.scores = lambda at, active: read.append(at) or scores(at, active)
    lists = [[[-(1 << 63), (1 << 63) - 1, []]] for _ in range(10)]
    walk.run(lists, True, 5)
    exact = np.sort(-(members @ candidates.T).astype(np.int64), axis=1)[:, :5]
    assert [[s for s, _ in mine[0][2]] for mine in lists] == exact.tolist() and len(read) * hardneg.STEP < 2500


def test_large_components():
    """Sums beyond a double stay exact, and beyond a long are an error."""
    big = np.array([[float(1 << 40), 3.0]])
    walk = hardneg.Walk(np.array([9 << 32]), np.zeros(1), big, 0, np.array([1]), np.zeros(1), np.array([[float(1 << 20) + 1, 1.0]]))
    assert walk.scores(0, np.array([0])).tolist() == [[(1 << 40) * ((1 << 20) + 1) + 3]]
    with pytest.raises(ValueError):
        hardneg.Walk(np.array([9 << 32]), np.zeros(1), big, 0, np.array([1]), np.zeros(1), big).scores(0, np.array([0]))


def test_least_negative():
    for p in range(-50, 51):
        least = hardneg.least_negative(p)
        assert 80 * p <= 100 * least and 80 * p > 100 * (least - 1)
