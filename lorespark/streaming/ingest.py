"""Extensions over files that arrive: continuous ingest, and counts per window. The store itself is batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorespark.functions.text import body_hash


def incoming(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


def new_bodies(stream: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose body wasn't seen in their namespace within the watermark; the state is bounded by it."""
    hashed = stream.withColumn("body_hash", body_hash(F.col("body")))
    return hashed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["namespace", "body_hash"])


def counts_by_window(stream: DataFrame, event_time: str, *keys: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """``(window_start, *keys, n)``: rows per tumbling window; rows later than the delay are dropped by the watermark."""
    grouped = stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), *keys, "n")


def upsert_stream(stream: DataFrame, apply_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch handed to a function of the batch and its number; a number seen before must be a no-op there."""
    return stream.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
