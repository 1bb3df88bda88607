"""Faults of the third round's findings, each on rows that showed it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dayboard.functions import dates, extract, text, urls
from dayboard.operators import checks, spans
from dayboard.plans import sources as S
from dayboard.plans import venues as V


def test_contexts_without_joined_or_shuffled_texts(spark):
    df = spark.createDataFrame([(1, "ab<a>c</a>de"), (2, None), (3, "none")], "id int, t string")
    rows = spans.contexts(df, ["id"], "t", "<a>.*?</a>", 1, 1)
    assert [tuple(r) for r in rows.collect()] == [(1, 0, "<a>c</a>", "b<a>c</a>d")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_described_posts_of_exactly_so_many_days_ago(spark):
    p = spark.createDataFrame([("https://v.jp/event/", "<a href='/event/1/'><a href='/event/2/'>")], "url string, html string")
    post = '<h3 class="h3_title01">T</h3><dl class="dl_postevent"><dt>開催期間</dt><dd>{0}</dd></dl>'
    d = spark.createDataFrame([("https://v.jp/event/1/", post.format("2025年11月26日")), ("https://v.jp/event/2/", post.format("2025年11月25日"))], "url string, html string")
    assert [r["date_from"] for r in S.described_posts(p, d, dt.date(2026, 11, 26)).select(F.col("date_from")).collect()] == ["2025-11-26"]


@pytest.mark.parametrize("use", [dates.single_date, dates.clock, extract.organizer, extract.implied_end_range_of_list, S._date_span, lambda t: V._date(t, dt.date(2026, 11, 26)), lambda t: text.first_capture(t, "(x)"), lambda t: urls.resolve(t, F.lit("https://v.jp/"))])
def test_a_text_is_computed_once(spark, use):
    """Each further use below a condition would compute the text anew, and nested uses multiply."""
    assert str(use(F.col("the_text"))).count("the_text") == 1


def test_checked_bodies_bound_the_bytes_of_a_batch(spark):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound)
    spark.conf.unset(bound)
    try:
        checks.checked_bodies(spark.createDataFrame([(b"x",)], "body binary"), "body", "utf-8")
        assert spark.conf.get(bound) == "4m"
    finally:
        spark.conf.set(bound, before)
