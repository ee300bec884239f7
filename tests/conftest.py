import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from newslake.session import build_session

    session = build_session("newslake-tests", master="local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column over one row of named values."""
    from pyspark.sql import functions as F

    def run(column, **values):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
        return df.select(column.alias("r")).collect()[0]["r"]

    return run
