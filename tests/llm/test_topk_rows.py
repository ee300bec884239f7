import pytest

from newslake.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def test_every_row_is_a_vector_of_its_own(spark, checkpoints):
    """Unequal rows of one id are two queries, each a candidate for the other; empty vectors score 0."""
    df = spark.createDataFrame([(20, [1.0]), (20, [2.0]), (21, [1.0]), (22, []), (23, [])], SCHEMA)
    got = sorted(map(tuple, topk.report(df).collect()))
    first = [(20, 1, 20, 8192), (20, 2, 21, 4096), (20, 3, 22, 0), (20, 4, 23, 0)]
    second = [(20, 1, 20, 8192), (20, 2, 21, 8192), (20, 3, 22, 0), (20, 4, 23, 0)]
    assert got == sorted(first + second)


def test_scores_that_no_long_holds_are_errors(spark, checkpoints):
    df = spark.createDataFrame([(20, [1e30]), (21, [1e30])], SCHEMA)
    with pytest.raises(Exception, match="OverflowError"):
        topk.report(df).collect()
