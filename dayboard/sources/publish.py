"""Publishing of outputs: what changed is written beside the old, a manifest names what holds, and the rest is removed.

A folder has ``data/part=../version=..``, written by Spark with dynamic partition overwrite, and ``manifest/version=..``
with the version, number of rows and digest of every part.  The last manifest that Spark marked as complete holds:
readers take the parts and versions that it names, so until a new one is complete they see the old output, whole.  A
run that fails leaves files that no manifest names; the next run writes over them or removes them.  One run at a time
publishes to a folder.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import require_valid
from .shared import keep
from .writers import venue_outputs


class Published(NamedTuple):
    version: int
    written: int
    unchanged: int
    removed: int


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete manifests, the newest first."""
    fs, where = _files(spark, f"{folder}/manifest")
    if not fs.exists(where):
        return []
    found = [p.getPath() for p in fs.listStatus(where)]
    done = [p.getName() for p in found if fs.exists(_files(spark, f"{p}/_SUCCESS")[1])]
    return sorted((int(n.removeprefix("version=")) for n in done if n.startswith("version=")), reverse=True)


_MANIFEST = "part string, version long, n long, digest string"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``(part, version, n, digest)`` of what holds; empty before anything is published."""
    found = _versions(spark, folder)
    if not found:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest/version={found[0]}")


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that hold, with their ``part``.  A filter on ``part`` prunes folders."""
    named = manifest(spark, folder).select("part", "version")
    rows = spark.read.option("inferColumnTypes", False).parquet(f"{folder}/data")
    rows = rows.withColumns({"part": F.coalesce(F.col("part").cast("string"), F.lit("")), "version": F.col("version").cast("long")})
    return rows.join(named, ["part", "version"], "left_semi").drop("version")


def _write_manifest(rows: DataFrame, folder: str, version: int) -> None:
    rows.select("part", "version", "n", "digest").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")


def publish(rows: DataFrame, folder: str, part: str = "part") -> Published:
    """Publish rows, which have the part they belong to as a column, in place of what holds in the folder.

    Parts whose rows are the same (by a digest of all columns, in any order) stay as they are; parts that have no rows
    any more go.  A null part is the part "".  Without rows nothing is published and what holds stays.
    """
    spark = rows.sparkSession
    rows = keep(rows.withColumn(part, F.coalesce(F.col(part).cast("string"), F.lit(""))).withColumnRenamed(part, "part"), "publish")
    columns = [F.col(c) for c in sorted(rows.columns) if c != "part"]
    # two hashes of each row, summed: equal rows in any order give an equal digest
    digest = F.concat_ws(":", *[F.sum(h(*columns).cast("decimal(20,0)")).cast("string") for h in (F.xxhash64, F.hash)])
    new = rows.groupBy("part").agg(F.count("*").alias("n"), digest.alias("digest"))
    known = _versions(spark, folder)
    version = (known[0] if known else 0) + 1
    old = manifest(spark, folder).select("part", F.col("version").alias("was"), F.col("n").alias("old_n"), F.col("digest").alias("old_digest"))
    both = keep(new.join(old, "part", "full"), "publish")
    same = F.col("n").eqNullSafe(F.col("old_n")) & F.col("digest").eqNullSafe(F.col("old_digest"))
    written, unchanged, removed, there = both.agg(F.count_if(F.col("n").isNotNull() & ~same), F.count_if(same), F.count_if(F.col("n").isNull()), F.count("n")).first()
    if not there or not (written or removed):
        return Published(known[0] if known else 0, 0, unchanged if there else 0, 0)
    changed = both.where(F.col("n").isNotNull() & ~same).select("part")
    out = rows.join(changed, "part", "left_semi").withColumn("version", F.lit(version))
    if written:
        out.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(f"{folder}/data")
    kept = both.where("n is not null").select("part", F.when(same, F.col("was")).otherwise(F.lit(version)).cast("long").alias("version"), "n", "digest")
    _write_manifest(kept, folder, version)
    _remove_unnamed(spark, folder)
    return Published(version, written, unchanged, removed)


def _remove_unnamed(spark: SparkSession, folder: str) -> None:
    """Delete data of parts and versions that the manifest does not name, and older manifests.

    The driver lists the folders, one a part, as Spark does when it reads them.
    """
    fs, where = _files(spark, f"{folder}/data")
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    named = {("part=" + (escape(r.part) if r.part else "__HIVE_DEFAULT_PARTITION__"), f"version={r.version}") for r in manifest(spark, folder).select("part", "version").toLocalIterator()}
    kept = {p for p, _ in named}
    for p in fs.listStatus(where) if fs.exists(where) else []:
        name = p.getPath().getName()
        if p.isDirectory() and name not in kept:
            fs.delete(p.getPath(), True)
        elif p.isDirectory():
            for v in fs.listStatus(p.getPath()):
                if (name, v.getPath().getName()) not in named:
                    fs.delete(v.getPath(), True)
    for old in _versions(spark, folder)[1:]:
        fs.delete(_files(spark, f"{folder}/manifest/version={old}")[1], True)


def finalize(events: DataFrame, folder: str, as_of: dt.date, ordinal: str = "ord", before_write=None, least: int = 1) -> Published:
    """Validate, make documents, let a hook change them, write what changed, and log: one call.

    ``events`` have a venue_id, an ``ordinal`` and the columns that documents hold.  Bad or too few events are an
    error, and what holds stays.  The hook gets and gives ``(venue_id, json)``.  The log is a table of its own below
    the folder with one row a run.
    """
    docs = venue_outputs(require_valid(events, ordinal, least), as_of, ordinal)
    docs = docs.transform(before_write) if before_write else docs
    done = publish(docs, folder, "venue_id")
    spark = events.sparkSession
    spark.createDataFrame([(as_of, *done)], "as_of date, version long, written long, unchanged long, removed long").coalesce(1).write.mode("append").json(f"{folder}/log")
    return done
