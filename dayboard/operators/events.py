"""From venue documents to event days: projection, retention, ranges, expansion, buckets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import strict_date
from ..functions.text import is_blank
from ..schema import EVENT_STRINGS


def explode_documents(docs: DataFrame, key: str = "file_name") -> DataFrame:
    """One row per event with its venue; the venue id falls back to the file's name.  ``ord`` is the place in the file."""
    name = F.regexp_replace(F.col(key), r"\.json$", "")
    return docs.select(F.coalesce("venue_id", name).alias("venue_id"), F.col("venue_name").alias("document_venue"), "venue_category", "last_success_at", F.col(key), F.posexplode("events").alias("ord", "event"))


def create_event(event: Column) -> list[Column]:
    """The fixed event columns of a raw event struct: legacy time keys folded in, empty times null, tags never null."""
    time = lambda new, *old: F.coalesce(*(F.nullif(event[c], F.lit("")) for c in (new, *old))).alias(new)
    times = {"open_time": time("open_time"), "start_time": time("start_time", "time_start"), "end_time": time("end_time", "time_end")}
    none = F.array().cast("array<string>")
    tags = F.struct(F.coalesce(event["tags"]["type"], F.lit("other")).alias("type"), F.coalesce(event["tags"]["genres"], none).alias("genres"), F.coalesce(event["tags"]["flags"], none).alias("flags"))
    return [*(times.get(n, event[n].alias(n)) for n in EVENT_STRINGS), tags.alias("tags")]


def page_event(title: Column, *texts: Column) -> list[Column]:
    """Display defaults: a title always, other texts empty rather than null."""
    return [F.coalesce(F.nullif(title, F.lit("")), F.lit("イベント名未定")), *(F.coalesce(t, F.lit("")) for t in texts)]


def retention_reason(first: Column, last: Column, as_of: dt.date, days: int = 365) -> Column:
    """in_range, expired, missing_date or invalid_date, by the end date, or the start if there is no end."""
    text = F.coalesce(F.nullif(last, F.lit("")), F.nullif(first, F.lit("")))
    d = strict_date(text)
    return F.when(text.isNull(), "missing_date").when(d.isNull(), "invalid_date").when(d < F.lit(as_of - dt.timedelta(days)), "expired").otherwise("in_range")


def keep_reason(reason: Column, *, keep_missing: bool = False, keep_invalid: bool = False) -> Column:
    return (reason == "in_range") | (F.lit(keep_missing) & (reason == "missing_date")) | (F.lit(keep_invalid) & (reason == "invalid_date"))


def sane_range(events: DataFrame, first: str = "date_from", last: str = "date_to", longest: int = 365) -> DataFrame:
    """Without undated and inverted ranges; a range of more than ``longest`` days is its first day."""
    end = F.coalesce(F.col(last), F.col(first))
    clamped = F.when(F.datediff(end, F.col(first)) > longest, F.col(first)).otherwise(end)
    return events.where(F.col(first).isNotNull() & (F.col(first) <= end)).withColumn(last, clamped)


def expand_days(events: DataFrame, first: str = "date_from", last: str = "date_to", *, window: tuple[dt.date, dt.date] | None = None, day: str = "day") -> DataFrame:
    """One row per day of each range, both ends included.  With a window, ranges are clipped before they are expanded,
    so no day outside is ever made."""
    a, b = F.col(first), F.coalesce(F.col(last), F.col(first))
    if window:
        a, b = F.greatest(a, F.lit(window[0])), F.least(b, F.lit(window[1]))
    return events.where(a <= b).withColumn(day, F.explode(F.sequence(a, b)))


def publish_window(as_of: dt.date, days: int = 365) -> tuple[dt.date, dt.date]:
    return as_of - dt.timedelta(days), as_of + dt.timedelta(days)


def noindex(day: Column, count: Column, as_of: dt.date, ahead: int = 120) -> Column:
    return (day < F.lit(as_of)) | (day > F.lit(as_of + dt.timedelta(ahead))) | (count == 0)


def held_on(first: Column, last: Column, day: dt.date) -> Column:
    return F.coalesce(F.lit(day).between(first, F.coalesce(last, first)), F.lit(False))


def status_bucket(first: Column, last: Column, day: dt.date) -> Column:
    """ongoing, upcoming or past; undated events are upcoming, inverted ones past."""
    t, end = F.lit(day), F.coalesce(last, first)
    return F.when(first.isNull(), "upcoming").when((first <= t) & (t <= end), "ongoing").when(first > t, "upcoming").otherwise("past")


def month_window(d: Column, as_of: dt.date, months: int = 7) -> Column:
    """From the first of this month, for so many months, the end excluded."""
    start = F.lit(as_of.replace(day=1))
    return (d >= start) & (d < F.add_months(start, months))


def month_overlaps(month_start: Column, first: dt.date, last: dt.date) -> Column:
    return (month_start <= F.lit(last)) & (F.last_day(month_start) >= F.lit(first))


def within_days(d: Column, as_of: dt.date, days: int = 365, *, oldest: bool = False) -> Column:
    """Later than so many days ago and no later than so many days ahead; with ``oldest`` the first of these days counts too."""
    first = as_of - dt.timedelta(days)
    return ((d >= F.lit(first)) if oldest else (d > F.lit(first))) & (d <= F.lit(as_of + dt.timedelta(days)))


def with_required(events: DataFrame, *columns: str) -> DataFrame:
    """Events in which none of the columns is null or blank."""
    for c in columns:
        events = events.where(~is_blank(F.col(c).cast("string")))
    return events


def needs_body(*columns: Column) -> Column:
    """Whether the body has to stand in, as every structured field is empty."""
    return ~has_details(*columns)


def has_details(*columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~is_blank(c)
    return out


def has_place(lat: Column, lng: Column) -> Column:
    """Both coordinates known; a zero counts as unknown."""
    return F.coalesce((lat != 0) & (lng != 0), F.lit(False))
