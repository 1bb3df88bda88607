"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where one machine is all there is, a private one if the
    session names none.  On a cluster it is an error to leave it unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="dayboard-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bound the bytes of an Arrow batch, so that long texts do not add up in a Python worker; a session that has a bound
    of its own keeps it."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(bound, most)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, with a short lineage that does not
    depend on any executor.  The table stays as long as the folder does."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
