"""Schemas of events, venue documents and venues."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

TAGS = StructType([StructField("type", StringType()), StructField("genres", ArrayType(StringType())), StructField("flags", ArrayType(StringType()))])

EVENT_STRINGS = ["title", "date_from", "date_to", "open_time", "start_time", "end_time", "description", "image_url", "price", "contact", "source_url", "source_type", "venue_name", "status", "body"]
EVENT = StructType([*(StructField(n, StringType()) for n in EVENT_STRINGS), StructField("tags", TAGS)])

#: What venue documents hold: current keys and the two legacy time keys.
RAW_EVENT = StructType([*EVENT.fields, StructField("time_start", StringType()), StructField("time_end", StringType())])
VENUE_DOCUMENT = StructType([StructField(n, StringType()) for n in ("venue_id", "venue_name", "venue_category", "last_success_at")] + [StructField("events", ArrayType(RAW_EVENT))])

SPOT = StructType([StructField(n, StringType()) for n in ("spot_id", "name", "prefecture", "municipality", "category", "description", "official_url", "google_url")] + [StructField("lat", DoubleType()), StructField("lng", DoubleType())])
