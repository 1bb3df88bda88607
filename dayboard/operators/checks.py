"""Errors as data: what is wrong with a landed document or a table, counts that come with the pass that writes, gates."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.values import rate_status
from ..sources.readers import decode_bytes, venue_documents
from ..sources.shared import small_batches

#: Typed reasons, in the order in which they are looked for.
EMPTY, UNDECODABLE, PARSE, SHAPE, UNDATED = "EMPTY_RESULT", "UNDECODABLE", "PARSE", "SHAPE", "UNDATED"


def checked_documents(spark: SparkSession, path: str, exclude: str = "template.json") -> DataFrame:
    """All landed venue documents, one row a file, with the reason why a file is bad, null if it is good.

    EMPTY_RESULT: a file without a byte, which the JSON source does not show at all; PARSE: no JSON; SHAPE: no list of
    events; UNDATED: events, but none with a first day.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    # no source has rows for files without a byte; their names are in the listing, which the driver holds anyway
    listed = spark.createDataFrame([(unquote(f.rpartition("/")[2]),) for f in found.inputFiles()], "file_name string").where(F.col("file_name") != exclude)
    files = listed.join(found.select(name.alias("file_name"), "length"), "file_name", "left")
    docs = venue_documents(spark, path, exclude=exclude)
    dated = F.exists("events", lambda e: ~is_blank(e["date_from"]))
    why = F.when(F.col("_corrupt_record").isNotNull(), PARSE).when(F.col("events").isNull(), SHAPE).when((F.size("events") > 0) & ~F.coalesce(dated, F.lit(False)), UNDATED)
    rows = files.join(docs.withColumns({"reason": why, "_read": F.lit(True)}), "file_name", "left")
    # a file of blanks only is read as nothing too
    return rows.withColumn("reason", F.when(F.col("length").isNull(), EMPTY).when(F.col("_read").isNull(), PARSE).otherwise(F.col("reason"))).drop("_read", "length")


def checked_bodies(rows: DataFrame, body: str, charset: str, text: str = "html") -> DataFrame:
    """Response bodies with their text and the reason why there is none: EMPTY_RESULT for null and empty ones,
    UNDECODABLE for what is no text in the charset or a broken archive."""
    small_batches(rows.sparkSession)
    rows = rows.withColumn(text, decode_bytes(F.col(body), charset))
    return rows.withColumn("reason", F.when(F.col(body).isNull() | (F.octet_length(body) == 0), EMPTY).when(F.col(text).isNull(), UNDECODABLE)).drop(body)


def write_checked(rows: DataFrame, path: str, reason: str = "reason", **measures: Column) -> dict:
    """Write good and bad rows beside each other in one pass, below ``bad=false`` and ``bad=true``, and return counts
    that come with it: ``rows``, ``bad`` and whatever ``measures`` say.  An empty table writes nothing but its schema."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.col(reason)).alias("bad"), *[m.alias(k) for k, m in measures.items()])
    counted.withColumn("bad", F.col(reason).isNotNull().cast("string")).write.mode("overwrite").partitionBy("bad").parquet(path)
    return seen.get


def good(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("bad = 'false'").drop("bad")


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("bad = 'true'").drop("bad")


def gate(expected: DataFrame, events: DataFrame, key: str, title: Column, dated: Column, title_rates: tuple[float, float] = (0.01, 0.03), date_rates: tuple[float, float] = (0.01, 0.03), enforce: bool = True) -> DataFrame:
    """``(key, total, missing_title, missing_date, title_status, date_status, status, enforced)`` of each output that is
    expected: fail if it is missing, warn if it has no events, else the worse of its two rates against its thresholds.
    A rate at a threshold keeps within it.  ``expected(key, there)`` says whether the output exists.  Without
    enforcement a fail counts as a warning."""
    counts = events.groupBy(key).agg(F.count("*").alias("total"), F.count_if(is_blank(title)).alias("missing_title"), F.count_if(~dated).alias("missing_date"))
    rows = expected.join(counts, key, "left").select(key, "there", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "missing_title", "missing_date")])
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    rows = rows.withColumns({"title_status": rate_status(rate("missing_title"), *title_rates), "date_status": rate_status(rate("missing_date"), *date_rates)})
    worst = F.when((F.col("title_status") == "fail") | (F.col("date_status") == "fail"), "fail").when((F.col("title_status") == "warn") | (F.col("date_status") == "warn"), "warn").otherwise("ok")
    status = F.when(~F.coalesce("there", F.lit(False)), "fail").when(F.col("total") == 0, "warn").otherwise(worst)
    rows = rows.withColumn("status", status).drop("there")
    return rows.withColumn("enforced", F.col("status") if enforce else F.when(F.col("status") == "fail", "warn").otherwise(F.col("status")))
