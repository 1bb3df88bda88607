"""Joins of events, venues and earlier outputs.

Sizes decide how they run: there are no broadcast hints, Spark broadcasts what it knows to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_dimension(facts: DataFrame, dim: DataFrame, key: str, label: str, fallback: str, address: list[str]) -> DataFrame:
    """Every fact with its venue's label, or ``fallback`` if there is none, and an address that is never null."""
    out = facts.join(dim, key, "left")
    return out.withColumn(label, F.coalesce(F.nullif(F.col(label), F.lit("")), F.col(fallback).cast("string"))).withColumn("address", F.concat_ws("", *address))


def with_counts(dim: DataFrame, facts: DataFrame, key: str, name: str = "n_events") -> DataFrame:
    """Every venue with its number of facts, 0 without any.  Facts are counted before they are joined."""
    return dim.join(facts.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def merge_sources(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], prefer_right: dict[str, Column] | None = None) -> DataFrame:
    """Full outer join on keys that may be null; the left value wins unless it is null or its condition (on columns
    ``l_*`` and ``r_*``) prefers the right one."""
    a = left.select(*[F.col(k).alias(f"lk_{k}") for k in keys], *[F.col(v).alias(f"l_{v}") for v in values], F.lit(1).alias("in_left"))
    b = right.select(*[F.col(k).alias(f"rk_{k}") for k in keys], *[F.col(v).alias(f"r_{v}") for v in values], F.lit(1).alias("in_right"))
    on = [F.col(f"lk_{k}").eqNullSafe(F.col(f"rk_{k}")) for k in keys]
    both = a.join(b, on, "full_outer")
    pick = []
    for v in values:
        mine, other = F.col(f"l_{v}"), F.col(f"r_{v}")
        cond = (prefer_right or {}).get(v)
        pick.append((F.coalesce(F.when(cond, other), mine, other) if cond is not None else F.coalesce(mine, other)).alias(v))
    side = F.when(F.col("in_left").isNull(), "right").when(F.col("in_right").isNull(), "left").otherwise("both")
    return both.select(*[F.coalesce(f"lk_{k}", f"rk_{k}").alias(k) for k in keys], *pick, side.alias("side"))


def published(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return wanted.join(existing.select(key), key, "left_semi")


def stale(existing: DataFrame, active: DataFrame, key: str) -> DataFrame:
    return existing.join(active.select(key), key, "left_anti")


def owner_conflicts(owned: DataFrame, output: str, owner: str, allowed: DataFrame | None = None) -> DataFrame:
    """Outputs with more than one owner, and how many; not those all of whose owners are in ``allowed(output, owner)``."""
    if allowed is None:
        return owned.groupBy(output).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")
    pairs = owned.select(output, owner).distinct().join(allowed.select(output, owner, F.lit(True).alias("_allowed")).distinct(), [output, owner], "left")
    return pairs.groupBy(output).agg(F.count("*").alias("owners"), F.count("_allowed").alias("_allowed")).where("owners > 1 AND _allowed < owners").drop("_allowed")


def stat_changes(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """added, removed, changed or same for every key of either snapshot; nulls compare equal."""
    b = before.select(key, F.struct(*values).alias("b"))
    a = after.select(key, F.struct(*values).alias("a"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, kind.alias("change"))


def with_next(df: DataFrame, partition: list[str], order: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns], *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])
