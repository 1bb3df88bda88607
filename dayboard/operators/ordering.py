"""Positions in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep

#: ``monotonically_increasing_id`` holds the partition above this bit and the row's place in it below.
_ROW_BITS = 33


def positions(df: DataFrame, order: list[str | Column], within: list[str] | None = None, parts: int | None = None, position: str = "position") -> DataFrame:
    """``df`` with each row's place, from 0, in the order given, counted anew in each group of ``within``.

    Rows are dealt by ranges of (within, order) and sorted in their partitions; a place is the row's place in its
    partition and the number of the group's rows in the partitions before.  What one task holds besides its range is a
    count for each partition.  ``order`` should end in columns that tell rows apart: rows that agree in all of them get
    different places in an order that is not defined.  Nulls come where Spark's order has them, and null groups are
    groups like others.  An empty table gives an empty one.
    """
    groups = list(within or [])
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*groups, *order]
    dealt = keep(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "positions")
    dealt = dealt.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    runs = dealt.groupBy("_part", *groups).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = runs.select(F.col("_part").alias("_run_part"), *[F.col(g).alias(f"_run_{i}") for i, g in enumerate(groups)], "_first", "_before")
    same = F.col("_part") == F.col("_run_part")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_run_{i}"))
    return dealt.join(runs, same).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(position))


def page_at(df: DataFrame, order: list[str | Column], offset: int, size: int, parts: int | None = None) -> DataFrame:
    """The rows of one page in the order given: a filter on positions, whatever the offset."""
    return positions(df, order, parts=parts).where(F.col("position").between(offset, offset + size - 1)).orderBy("position")


def followers(keys: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``(key, next)``: each distinct key that is not null with the one after it; the last is followed by the first."""
    placed = positions(keys.where(F.col(key).isNotNull()).select(key).distinct(), [key], parts=parts)
    total = placed.agg(F.max("position") + 1).first()[0] or 1
    after = placed.select(F.col(key).alias("next"), F.pmod(F.col("position") - 1, F.lit(total)).alias("position"))
    return placed.join(after, "position").select(key, "next")
