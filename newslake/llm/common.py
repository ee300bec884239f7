"""Reading tables, naming rows and cutting lineage for the operators of this package."""

from __future__ import annotations

import gc
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.session import checkpoint_dir

#: Characters that separate words in most contracts: space and \t to \r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, path: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One input table, with only the columns that the caller uses."""
    df = spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(True)


def tidy(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of finished phases, which can hold as much as the texts."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, stem: str = "own") -> str:
    """A prefix with which no column of ``df`` begins, for helper columns beside a caller's."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(stem) for c in taken):
        stem += "_"
    return stem + "_"


def same_columns(df: DataFrame) -> list[Column]:
    """The columns of a frame by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def text_of(name: str = "text") -> Column:
    """Null-safe text: null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def wordlist(text: Column) -> Column:
    """The words of a text, in order."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))

