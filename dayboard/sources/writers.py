"""Sinks: partitioned JSON, changed pages only, sitemaps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import pretty_json


def write_events(events: DataFrame, path: str) -> bool:
    """Write one folder per venue; nothing is written, and nothing overwritten, if there are no rows."""
    if events.isEmpty():
        return False
    events.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("venue_id").json(path)
    return True


def venue_outputs(events: DataFrame, as_of: dt.date, ordinal: str) -> DataFrame:
    """``(venue_id, json)``: each venue's document with its events, of any columns, in the order of ``ordinal``, ties in that of their
    columns.  A venue without a name has no key for it.
    """
    kept = [c for c in events.columns if c not in ("venue_id", "venue_name", ordinal)]
    row = F.struct(F.col(ordinal), F.struct(*kept).alias("event"))
    docs = events.groupBy("venue_id").agg(F.max("venue_name").alias("venue_name"), F.array_sort(F.collect_list(row)).alias("rows"))
    docs = docs.select("venue_id", F.nullif("venue_name", F.lit("")).alias("venue_name"), F.lit(as_of.isoformat()).alias("last_success_at"), F.col("rows.event").alias("events"))
    named, bare = F.struct("venue_id", "venue_name", "last_success_at", "events"), F.struct("venue_id", "last_success_at", "events")
    made = [pretty_json(x, docs.select(x.alias("x")).schema["x"].dataType) for x in (named, bare)]
    return docs.select("venue_id", F.when(F.col("venue_name").isNotNull(), made[0]).otherwise(made[1]).alias("json"))


def changed_pages(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages ``(path, content)`` whose content is not in the manifest ``(path, digest)`` of the last run."""
    return pages.withColumn("digest", F.sha2("content", 256)).join(manifest.select("path", "digest"), ["path", "digest"], "left_anti")


def splice(text: str, start: str, end: str, body: str):
    """Column: what stands between two markers replaced; texts without markers stay."""
    import re

    return F.regexp_replace(F.col(text), rf"(?s)({re.escape(start)}).*?({re.escape(end)})", F.concat(F.lit("$1"), F.lit(body.replace("\\", "\\\\").replace("$", "\\$")), F.lit("$2")))


def write_sitemap(entries: DataFrame, path: str) -> None:
    """``(category, loc, lastmod)`` as text, one folder a category, sorted by address."""
    from ..operators.render import sitemap_xml

    lines = entries.select("category", sitemap_xml(F.col("loc"), F.col("lastmod").cast("string")).alias("value"), "loc")
    lines.repartition("category").sortWithinPartitions("category", "loc").drop("loc").write.mode("overwrite").partitionBy("category").text(path)
