"""Shared-folder storage for intermediate tables.

Intermediate results that are read more than once are written as Parquet below the folder named by
``spark.checkpoint.dir``.  Unlike a local checkpoint they survive the loss of any executor, and unlike
``cache()`` they cut the lineage, so iterative operators keep small plans.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  In local mode, where one machine is all there is, a private one is made if
    none is configured; on a cluster that is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="dayboard-"))
        found = sc.getCheckpointDir()
    return found


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bound the bytes of an Arrow batch, so that long texts do not add up in a task; a session that has a bound of
    its own keeps it."""
    if spark.conf.get(_BATCH_BYTES) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(_BATCH_BYTES, most)


class Stash:
    """Tables written to the shared folder by one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it read back; the schema is passed on, so empty tables work too."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a stashed table that nothing reads any more."""
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
