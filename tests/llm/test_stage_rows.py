"""The pipeline's stages on odd rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

CLASHES = ["key", "extra", "k", "x", "rest", "near_id", "near_mark", "mix_row", "mix_size", "mix_taken", "q", "q_kept", "q_clean_text",
           "own_key", "own_kept", "own_row", "OWN_id", "row", "size", "group", "taken", "a.b"]
STAGES = corpus_pipeline.STAGES[:-1]


@pytest.fixture(scope="module")
def clashing(odd):
    base = odd.select("doc_id", "text", "lang", "source", "n_chars")
    return base.withColumns({c: F.concat(F.lit(c + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES}).cache()


@pytest.mark.parametrize("name, stage", STAGES)
def test_columns_come_through(spark, clashing, name, stage):
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    got, want = stage(spark, clashing, ""), stage(spark, plain, "")
    assert got.columns == clashing.columns
    rows = got.collect()
    assert rows and all(r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
    key = lambda r: str((r[0], r[1]))
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(map(tuple, want.collect()), key=key)


@pytest.mark.parametrize("name, stage", STAGES)
def test_empty_tables_stay_empty(spark, clashing, name, stage):
    got = stage(spark, clashing.where("false"), "")
    assert got.columns == clashing.columns and got.collect() == []


def test_tokens_of_odd_rows(spark, clashing):
    stage = dict(corpus_pipeline.STAGES)["tokenize"]
    assert stage(spark, clashing, "").count() == clashing.count()
    assert stage(spark, clashing.where("false"), "").count() == 0
