"""Streaming extension: venue documents as they land, and event time windows.

The batch engine has no streams; these show the same operators on unbounded input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import create_event
from ..schema import VENUE_DOCUMENT


def landed_events(spark: SparkSession, path: str, *, watermark: str = "365 days") -> DataFrame:
    """Events of documents as they arrive, those that land again within the watermark once.

    An event is told by its venue, address, title, first day and start; nulls are equal in each.
    """
    docs = spark.readStream.schema(VENUE_DOCUMENT).option("multiLine", True).json(path)
    rows = docs.select("venue_id", F.to_timestamp("last_success_at").alias("seen_at"), F.explode("events").alias("event"))
    return rows.select("venue_id", "seen_at", *create_event(F.col("event"))).withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["venue_id", "source_url", "title", "date_from", "start_time"])


def hourly_counts(events: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Counts by hour and type; rows later than the watermark are dropped when run as a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
