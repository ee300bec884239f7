import random

import numpy as np

import brute
import corpus_pipeline
from newslake.llm import neardup


def linked(rows, percent):
    """Ids that stay, by comparing all pairs."""
    sets = [brute.shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    part = brute.components(len(rows), links)
    return sorted(min(d for (d, _), q in zip(rows, part) if q == p) for p in set(part))


def test_stage_links_pairs_from_80_percent(spark, checkpoints):
    rng = random.Random(11)
    rows = []
    for i in range(120):  # pairs of similarity about 0.72 to 0.9
        words = [f"p{i}x{k}" for k in range(400)]
        other = list(words)
        for k in range(5 + i % 12):
            other[20 + 24 * k] = f"changed{rng.random()}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = linked(rows, 80)
    assert len(linked(rows, 85)) > len(want)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == want
    assert sorted(r.doc_id for r in neardup.near_duplicates(df).where("kept").collect()) == linked(rows, 85)


def test_bands_and_estimate_follow_the_threshold():
    assert neardup.bands_for(85) == (24, 5) and neardup.bands_for(80) == (27, 4)
    for percent in range(50, 100):
        bands, rows = neardup.bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= neardup.MISSED and bands * rows < neardup.MINIMA
    assert 0.67 < neardup.least_estimate(80) < 0.69 and neardup.least_estimate(85) < 0.76


def test_estimates_at_the_threshold_are_not_cut():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(300):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (400, 50, 50))
        sets += [np.unique(np.concatenate([common, x])) for x in (a, b)]
    _, low = neardup.Signer(80).sign(sets)
    for i in range(0, len(sets), 2):
        assert neardup.links_of([0, 1], [True, True], sets[i:i + 2], low[i:i + 2], 80) == [(1, 0)]


def test_stage_on_given_documents_by_brute_force(spark, checkpoints):
    good = corpus_pipeline.quality_rules(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "")
    rows = [(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, good, "").collect()) == linked(rows, 80)
