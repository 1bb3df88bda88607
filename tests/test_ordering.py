"""Positions by range partitions against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from dayboard.operators import ordering as O
from dayboard.operators import ranking


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_same_as_row_number(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.randrange(40), k) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    key = lambda r: (r[0] is not None, r[0] or "", r[1], r[2])
    got = sorted((r.position, r.g, r.x, r.id) for r in O.positions(df, ["x", "id"], parts=parts).collect())
    assert [g[2:] for g in got] == sorted((x, i) for _, x, i in rows) and [g[0] for g in got] == list(range(700))
    want, n = {}, {}
    for g, x, i in sorted(rows, key=key):
        want[i] = n[g] = n.get(g, -1) + 1
    assert {r.id: r.place for r in O.positions(df, ["x", "id"], ["g"], parts, "place").collect()} == want
    down = O.positions(df, [F.desc("x"), F.desc("id")], parts=parts)
    assert [r.id for r in down.orderBy("position").collect()] == [i for _, i in sorted(((x, i) for _, x, i in rows), reverse=True)]


def test_hot_group_needs_no_window_over_it(spark):
    df = spark.range(20000).select(F.lit("hot").alias("g"), "id")
    out = O.positions(df, ["id"], ["g"], 8)
    assert out.where("id <> position").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1  # over one row a partition


def test_pages_and_followers(spark):
    df = spark.createDataFrame([(k % 7, k) for k in range(100)], "x int, id int")
    want = sorted((k % 7, k) for k in range(100))[35:55]
    assert [tuple(r)[:2] for r in O.page_at(df, ["x", "id"], 35, 20, 4).collect()] == want
    assert [tuple(r) for r in ranking.page(df, [F.asc("x"), F.asc("id")], 35, 20).collect()] == want
    got = {r.id: r.next for r in O.followers(spark.createDataFrame([(5,), (2,), (9,), (5,), (None,)], "id long"), "id", 3).collect()}
    assert got == {2: 5, 5: 9, 9: 2}
    assert O.followers(spark.createDataFrame([], "id long"), "id").count() == 0
    assert [tuple(r) for r in O.followers(spark.createDataFrame([(1,)], "id long"), "id").collect()] == [(1, 1)]
    assert O.positions(df.where("x > 9"), ["id"]).count() == 0
