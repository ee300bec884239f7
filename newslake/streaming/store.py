"""What ticks have written: rows by day of publication, and an index of the keys seen so far.

A tick reads the days of its horizon and the buckets of its own keys, so its reads hang on the tick and not on the age of the
store. The number of a batch is part of each folder, and batch n reads what the batches before n wrote: a repeated batch
rewrites its own folders and sees what it saw before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from newslake.functions.base import text
from newslake.session import cut

#: Buckets of an index; a bucket is a file per folder.
BUCKETS = 256
#: Folders of a level that become one folder of the next level.
FAN_IN = 16


def key_rows(rows: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(kind, key) of the rows' keys, each once; empty and null keys are none."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), text(key).alias("key")) for kind, key in kinds.items()])
    return rows.select(F.explode(F.filter(pairs, lambda p: p["key"] != "")).alias("p")).select("p.kind", "p.key").distinct()


def key_columns(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Keys as a table with a column per kind, of which one is filled in each row."""
    return found.select(*[F.when(F.col("kind") == kind, F.col("key")).alias(kind) for kind in kinds])


def read_batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows that the batches of a stream have written; none if there was no batch."""
    empty = spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    empty.write.mode("ignore").partitionBy("batch").parquet(path)  # the folder alone
    return spark.read.schema(schema).parquet(path)


class KeyIndex:
    """Exact set of (kind, key), in hash buckets, written batch by batch.

    Each batch is a folder of level 0. Whenever ``fan_in`` folders of a level are full, the next batch first merges them into
    one of the level above, so the batches before number n lie in fewer than ``fan_in`` folders per level, which follow from
    n alone: nothing is listed, renamed or deleted. A key is written once per level. Batches are numbered without gaps from 0.
    """

    SCHEMA = "kind string, key string, bucket int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fan_in: int = FAN_IN):
        self.spark, self.path, self.buckets, self.fan_in = spark, path, buckets, fan_in

    def _folder(self, level: int, part: int) -> str:
        return f"{self.path}/level={level}/part={part}"

    def folders(self, batch_id: int) -> list[str]:
        """The folders that together hold the batches before ``batch_id``."""
        out, level, full = [], 0, batch_id
        while full:
            above = full // self.fan_in
            out += [self._folder(level, part) for part in range(above * self.fan_in, full)]
            level, full = level + 1, above
        return out

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(*folders).select("kind", "key", "bucket")

    def _write(self, keys: DataFrame, level: int, part: int) -> None:
        placed = keys.repartition("bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(self._folder(level, part))

    def merge(self, batch_id: int) -> None:
        """Merge the levels that the batches before ``batch_id`` have filled; to be called before ``seen``."""
        level, full = 0, batch_id
        while full and full % self.fan_in == 0:
            parts = range(full - self.fan_in, full)
            level, full = level + 1, full // self.fan_in
            self._write(self._read([self._folder(level - 1, p) for p in parts]), level, full - 1)

    def _placed(self, keys: DataFrame) -> DataFrame:
        return keys.select("kind", "key", F.pmod(F.xxhash64("kind", "key"), F.lit(self.buckets)).cast("int").alias("bucket"))

    def seen(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """Those of the keys that batches before ``batch_id`` have added."""
        folders, placed = self.folders(batch_id), self._placed(keys)
        if not folders:
            return keys.select("kind", "key").where(F.lit(False))
        placed = cut(placed)
        touched = [r["bucket"] for r in placed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        stored = self._read(folders).where(F.col("bucket").isin(touched))
        return placed.join(stored, ["bucket", "kind", "key"], "left_semi").select("kind", "key")

    def add(self, keys: DataFrame, batch_id: int) -> None:
        self._write(self._placed(keys), 0, batch_id)


class DatedStore:
    """Rows in folders by day of ``published_at`` and then by batch; a reader names the first day that it needs."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        own = {"published_date", "batch"}
        self.spark, self.path = spark, path
        self.schema = StructType([f for f in schema if f.name not in own]
                                 + [StructField("published_date", StringType()), StructField("batch", LongType())])
        empty = spark.createDataFrame([], self.schema)
        empty.write.mode("ignore").partitionBy("published_date", "batch").parquet(path)  # the folder alone

    def since(self, start: Column, batch_id: int) -> DataFrame:
        """Rows of earlier batches from the day of ``start`` on, a constant expression, so that other days are not read."""
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows.where((F.col("published_date") >= F.date_format(start, "yyyy-MM-dd")) & (F.col("batch") < batch_id))

    def of_batch(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col("batch") == batch_id)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        dated = rows.withColumn("published_date", F.date_format("published_at", "yyyy-MM-dd")).withColumn("batch", F.lit(batch_id).cast("long"))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("published_date", "batch").parquet(self.path)
