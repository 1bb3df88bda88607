"""Sorts, top rows, neighbours, running state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_space
from .ordering import page_at


def ja(column: str) -> Column:
    """Sort key in Japanese order."""
    return F.collate(F.coalesce(F.col(column), F.lit("")), "ja")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, position: str = "position") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).where(F.col(position) <= n)


def neighbours(keys: DataFrame, key: str) -> DataFrame:
    """Each distinct key with the one before and after it.

    The keys of this window are calendar days or the like, of which there are few whatever the facts' number; they
    are made distinct first.
    """
    w = Window.orderBy(key)
    return keys.select(key).distinct().select(key, F.lag(key).over(w).alias(f"prev_{key}"), F.lead(key).over(w).alias(f"next_{key}"))


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows of a page: by Spark's own top rows for the first pages, by positions in the whole order for later ones."""
    return df.orderBy(*order).offset(offset).limit(size) if offset + size <= 10_000 else page_at(df, order, offset, size)


def search(df: DataFrame, name: str, keyword: str) -> DataFrame:
    """Rows whose name contains the keyword, its case as it is; an empty one finds all."""
    return df.where(F.contains(F.col(name), F.lit(keyword.strip())))


def suggestions(df: DataFrame, name: str, keyword: str, ordinal: str, most: int = 5) -> DataFrame:
    """The first rows in the order of ``ordinal`` whose name contains the keyword; an empty one suggests nothing."""
    found = search(df, name, keyword)
    return found.orderBy(ordinal).limit(most) if keyword.strip() else found.limit(0)


def linked_card(cards: DataFrame, title: str, venue: str, asked: str, place: str, ordinal: str) -> DataFrame:
    """The card that a link means: the first whose title is the one asked for and whose venue, if one is asked for, is
    that; white space does not count beyond a single space.  None or one row; none if no title is asked for."""
    wanted, where = (" ".join((x or "").split()) for x in (asked, place))
    same = (normalize_space(F.coalesce(F.col(title), F.lit(""))) == wanted) & F.lit(wanted != "")
    return cards.where(same & (F.lit(where == "") | (normalize_space(F.coalesce(F.col(venue), F.lit(""))) == where))).orderBy(ordinal).limit(1)


def carry_forward(df: DataFrame, partition: list[str], order: list[str], reset: Column, columns: list[str]) -> DataFrame:
    """Last value of each column so far that is not null, forgotten at each reset."""
    so_far = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("segment", F.sum(F.when(reset, 1).otherwise(0)).over(so_far))
    inside = Window.partitionBy(*partition, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.select("*", *[F.last(c, ignorenulls=True).over(inside).alias(f"{c}_filled") for c in columns])


def segments(df: DataFrame, partition: list[str], order: list[str], phase: str) -> DataFrame:
    """Number of the run of equal phases that each row belongs to, from 1."""
    w = Window.partitionBy(*partition).orderBy(*order)
    change = F.when(F.lag(phase).over(w).eqNullSafe(F.col(phase)), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("segment", F.sum("_change").over(w)).drop("_change")


def within_budget(df: DataFrame, partition: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """Rows while the length of the texts so far, with a separator each, stays within the budget."""
    so_far = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(F.length(text) + 1).over(so_far) - 1).where(F.col("used") <= budget)


def carry_in_row(parts: Column, names: list[str]) -> Column:
    """Fill missing leading fields of an array of structs from the element before; elements before any value stay null."""
    zero = F.array().cast(f"array<struct<{','.join(n + ':string' for n in names)}>>")
    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        return F.concat(done, F.array(F.struct(*[F.coalesce(x[n], last[n]).alias(n) for n in names])))
    return F.aggregate(parts, zero, step)
