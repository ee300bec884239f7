import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, copies, near copies, shared passages, repeated ids and rows."""
    rng = random.Random(3)
    base, passage = prose(rng, 300), prose(rng, 80)
    near = base.split()
    near[150] = "changed"
    long = prose(rng, 20_000)
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", None), (3, " ".join(near), "en", "b", 3), (4, None, None, None, None),
        (5, "", "de", "b", 0), (6, " \n\t ", None, "c", 4), (7, long, "fr", None, 5), (7, long, "fr", None, 5), (None, "no id here", "en", "a", 2),
        (None, base.upper(), None, "zz", 9), (8, "one", "en", "a", 3), (9, prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 60), "de", "c", 1),
        (10, prose(rng, 90) + " é ü 日本 " + passage + " " + prose(rng, 10), "de", "c", 1), (11, "x" * 5000, "en", "b", 2), (12, "ab " * 700, "es", "b", 2),
        (13, "12 34 !! ??", "en", "a", 2), (14, "Home | About | Menu | Contact\n" + base, "en", "a", 2),
    ]


@pytest.fixture(scope="session")
def odd(spark, checkpoints, odd_rows):
    """The odd rows, with columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    clash = {c: F.lit("mine") for c in ("key", "row", "size", "rank", "kept", "score", "ids", "hits", "group", "node", "q_kept", "target")}
    return df.withColumns(clash).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
