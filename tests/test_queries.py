"""Every query of the catalogue against its SQL, on the smallest tables."""

import duckdb
import pytest

from dayboard import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:19].removesuffix(" 00:00:00")
    return v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_as_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    cur = duck.execute(Q.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    left = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    right = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert left == right


def test_each_query_has_sql():
    assert set(Q.QUERIES) == set(Q.SQL)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(e.queries())


def test_expansion_is_clipped_before_it_explodes(spark):
    plan = Q.QUERIES["event_day_expand_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "greatest" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_scan_reads_needed_columns_only(spark):
    plan = Q.QUERIES["venue_event_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint>" in plan and "l_extendedprice" not in plan
