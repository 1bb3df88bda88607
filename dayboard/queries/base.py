"""What the queries share: the reference day, tables, and orders as events with a range of days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import read_table as table

__all__ = ["AS_OF", "EVENTS_AS_OF", "F", "order_events", "table"]

AS_OF = dt.date(1998, 6, 15)
EVENTS_AS_OF = dt.date(2024, 1, 20)


def order_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as events: from the order day, for 0 to 29 days more."""
    o = table(spark, sf, "orders")
    first = F.to_date("o_orderdate")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", first.alias("date_from"), F.date_add(first, (F.col("o_orderkey") % 30).cast("int")).alias("date_to"))


#: The same in SQL, as the start of a WITH clause.
ORDERS = "WITH ev AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate::DATE AS date_from, o_orderdate::DATE + (o_orderkey % 30)::INT AS date_to FROM orders)"
#: Days of these events within a year of the reference day.
EXPANDED = ORDERS + ", day AS (SELECT * FROM (SELECT *, unnest(generate_series(date_from, date_to, INTERVAL 1 DAY))::DATE AS d FROM ev) WHERE d BETWEEN DATE '1997-06-15' AND DATE '1999-06-15')"
