"""Deduplication across runs and over streams."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.operators.exact import keep_first


def unseen(new: DataFrame, seen: DataFrame, key: Column, seen_key: str = "key", order_col: str = "row_id") -> DataFrame:
    """The first record of each key that ``seen`` lacks; null keys always stay."""
    fresh = new.withColumn("__k", key)
    fresh = fresh.join(seen.select(F.col(seen_key).alias("__k")).distinct(), "__k", "left_anti")
    return keep_first(fresh, F.col("__k"), order_col).select(*new.columns)


class SeenStore:
    """A Parquet table of seen key digests that outlives runs; each run appends one batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema("key string").parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "key string")

    def take(self, new: DataFrame, key: Column, order_col: str = "row_id") -> DataFrame:
        return unseen(new, self.table(), F.sha2(key.cast("string"), 256), order_col=order_col)

    def remember(self, kept: DataFrame, key: Column) -> None:
        kept.select(F.sha2(key.cast("string"), 256).alias("key")).where("key is not null").write.mode("append").parquet(self.path)

    def stats(self, probe: DataFrame, key: Column) -> DataFrame:
        """total_hashes in the store and how many of the probe's keys are in it."""
        total = self.table().agg(F.countDistinct("key").alias("total_hashes"))
        hits = probe.select(F.sha2(key.cast("string"), 256).alias("key")).join(self.table().distinct(), "key", "left_semi").agg(F.count(F.lit(1)).alias("hits"))
        return total.join(hits)

    def clear(self) -> None:
        self.spark.createDataFrame([], "key string").write.mode("overwrite").parquet(self.path)


def stream_dedup(stream: DataFrame, keys: list[str], watermark: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """The first event of each key; with an event-time column, state older than the delay goes."""
    if watermark:
        return stream.withWatermark(watermark, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def run_stream(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Drains what is available into Parquet, exactly once."""
    os.makedirs(checkpoint, exist_ok=True) if "://" not in checkpoint else None
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
