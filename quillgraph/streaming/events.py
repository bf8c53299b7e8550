"""Streams (an extension: letters are batch data): incremental letters, windowed event counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Events from a folder of Parquet files, new files as they come."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, events, total): tumbling windows; batch and stream alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "events", F.round("total", 6).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, events): runs of a user's events without a longer gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return by.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def changed_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, sha256) whose content the manifest of the last run doesn't have: what a stage has to do again."""
    return current.join(manifest, ["path", "sha256"], "left_anti")
