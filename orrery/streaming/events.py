"""Structured Streaming over the event table: windowed means with late rows allowed for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_means(events: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """``start``, ``event_type``, ``n``, ``mean``: tumbling windows; rows later than ``lateness`` are left out of a stream."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("ts", lateness)
    grouped = stamped.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def stream_events(spark: SparkSession, directory: str) -> DataFrame:
    """The event files of a directory as a stream."""
    schema = spark.read.parquet(directory).schema
    return spark.readStream.schema(schema).parquet(directory)
