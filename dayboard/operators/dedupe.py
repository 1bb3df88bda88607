"""Removal of duplicates with a defined survivor: a window over the key, ordered by an explicit ordinal.

Windows keep one row per key, so Spark prunes before it shuffles (WindowGroupLimit); nothing depends on the order
in which rows happen to arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank


def _survivor(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def keep_first(df: DataFrame, keys: list[str], ordinal: str, *, drop_blank: bool = False) -> DataFrame:
    """The first row of each key; nulls are equal.  With ``drop_blank``, rows without a key go."""
    if drop_blank:
        for k in keys:
            df = df.where(~is_blank(F.col(k)))
    return _survivor(df, keys, [F.col(ordinal).asc()])


def keep_last_at_first(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of each key, with the ordinal of the first."""
    rest = [c for c in df.columns if c not in keys and c != ordinal]
    out = df.groupBy(*keys).agg(F.min(ordinal).alias(ordinal), F.max_by(F.struct(*rest), ordinal).alias("_row"))
    return out.select(*keys, ordinal, "_row.*")


def keep_preferred(df: DataFrame, keys: list[str], worse: Column, ordinal: str) -> DataFrame:
    """The first row that is not worse, else the first row."""
    return _survivor(df, keys, [F.coalesce(worse, F.lit(False)).asc(), F.col(ordinal).asc()])


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows with the number of their source; columns that one lacks are null."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_ord", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out
