"""The listing pipeline: documents to tagged, retained events, to event days, to page rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.dates import strict_date
from ..operators.events import create_event, expand_days, explode_documents, keep_reason, noindex, publish_window, retention_reason, sane_range
from ..operators.ranking import neighbours


def silver_events(docs: DataFrame, *, as_of: dt.date) -> DataFrame:
    """Normalised, tagged events within the retention window: all of them, as a venue may give all its events one
    address; what is repeated on a page is the extractors' to remove."""
    rows = explode_documents(docs)
    keep = [c for c in rows.columns if c != "event"]
    events = rows.select(*keep, *create_event(F.col("event")))
    events = events.where(keep_reason(retention_reason(F.col("date_from"), F.col("date_to"), as_of)))
    text = tags.search_text(F.col("title"), F.col("venue_category"))
    tagged = F.struct(tags.event_type(F.col("title"), F.col("venue_category")).alias("type"), tags.genres(text).alias("genres"), tags.flags(text, F.col("price"), F.col("start_time"), F.col("end_time"), F.col("date_from"), F.col("date_to")).alias("flags"))
    return events.withColumn("tags", tagged)


def gold_days(events: DataFrame, *, as_of: dt.date) -> DataFrame:
    """One row per event and day inside the publish window."""
    dated = events.withColumns({"from_day": strict_date(F.col("date_from")), "to_day": strict_date(F.coalesce("date_to", "date_from"))})
    return expand_days(sane_range(dated, "from_day", "to_day"), "from_day", "to_day", window=publish_window(as_of))


def day_pages(days: DataFrame, *, as_of: dt.date) -> DataFrame:
    """Each published day with its count, neighbours and index flag."""
    counts = days.groupBy("day").agg(F.count("*").alias("n_events"))
    return counts.join(neighbours(counts, "day"), "day").withColumn("noindex", noindex(F.col("day"), F.col("n_events"), as_of))
