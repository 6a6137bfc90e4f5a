"""Event-time pipelines over the events table's schema. Each takes a streaming or a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def describe_stream(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count, missing, extremes, mean and population deviation by window; a late event within `delay` still counts."""
    v = F.col("value")
    return _timed(events).withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w")).agg(F.count(v).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("n_missing"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).select(F.col("w.start").alias("start"), "n", "n_missing", "min", "max", "mean", "std")


def type_counts(events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events and their values by window and type."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return _timed(events).withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a user: runs of events with gaps under `gap`."""
    return _timed(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drops repeated deliveries of an event within the delay."""
    return _timed(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
