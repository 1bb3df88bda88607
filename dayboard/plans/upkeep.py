"""Upkeep of event days and pages from what changed, instead of all over."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import expand_days, publish_window, sane_range
from ..operators.ranking import neighbours
from ..operators.render import day_documents
from ..sources.shared import keep


def event_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``(key, old, new)``: rows that were added, removed or changed, as structs; null where there is none.

    Both sides have the same columns and one row a key.
    """
    values = [c for c in after.columns if c != key]
    packed = lambda df, name: df.select(key, F.xxhash64(*values).alias("h"), F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256).alias("d"), F.struct(*after.columns).alias(name))
    both = packed(before.select(after.columns), "old").join(packed(after, "new").withColumnsRenamed({"h": "h2", "d": "d2"}), key, "full")
    return both.where(~(F.col("h").eqNullSafe(F.col("h2")) & F.col("d").eqNullSafe(F.col("d2")))).select(key, "old", "new")


def _days(events: DataFrame, as_of: dt.date) -> DataFrame:
    return expand_days(sane_range(events, "date_from", "date_to"), window=publish_window(as_of))


class Refreshed(NamedTuple):
    """Days whose pages change, all event-day rows of them, and all days that there are now."""

    touched: DataFrame
    rows: DataFrame
    names: DataFrame


def refresh_days(days: DataFrame, changes: DataFrame, key: str, as_of: dt.date) -> Refreshed:
    """What changes in the event days that hold, by ``changes`` of events.

    Touched are the days of old and new ranges, and those whose neighbours are other days than before, as pages link to
    them.  Of ``days``, which should be partitioned by day, touched days alone are read, and the names of all.  The
    driver holds days of the publish window.  The reference day is that with which ``days`` were made.
    """
    changes = keep(changes, "changes")
    old = _days(changes.where("old is not null").select("old.*"), as_of).select("day")
    new = keep(_days(changes.where("new is not null").select("new.*"), as_of).select(*days.columns), "new-days")
    names = keep(days.select("day").distinct(), "names")
    changed = [r.day for r in old.unionByName(new.select("day")).distinct().collect()]
    rows = keep(days.where(F.col("day").isin(changed)).join(changes.select(key), key, "left_anti").select(days.columns).unionByName(new), "rows")
    now = keep(names.where(~F.col("day").isin(changed)).unionByName(rows.select("day").distinct()), "names")
    before, after = neighbours(names, "day"), neighbours(now, "day").withColumnsRenamed({"prev_day": "p", "next_day": "n"})
    other = after.join(before, "day", "left").where(~(F.col("p").eqNullSafe(F.col("prev_day")) & F.col("n").eqNullSafe(F.col("next_day"))))
    beside = [r.day for r in other.select("day").collect() if r.day not in set(changed)]
    touched = now.sparkSession.createDataFrame([(d,) for d in sorted({*changed, *beside})], "day date")
    return Refreshed(touched, rows.unionByName(days.where(F.col("day").isin(beside)).select(days.columns)), now)


def refresh_pages(refreshed: Refreshed, as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """``(pages, gone)``: the pages that change, as ``render.day_documents`` makes them, and days that have none any more."""
    pages = day_documents(refreshed.rows, as_of, refreshed.names)
    return pages, refreshed.touched.join(refreshed.names, "day", "left_anti")
