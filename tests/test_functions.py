"""Scalar columns against hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dayboard.functions import dates as D
from dayboard.functions import tags as G
from dayboard.functions import text as T
from dayboard.functions import urls as U
from dayboard.functions import values as V


@pytest.mark.parametrize("raw, want", [("&amp;lt;", "<"), ("&#039;", "'"), ("&#39;", "&#39;"), ("a&nbsp;b", "a b"), ("&copy;", "&copy;")])
def test_entities(one, raw, want):
    assert one(T.decode_entities(F.lit(raw))) == want


def test_space_of_all_kinds(one):
    assert one(T.normalize_space(F.lit("　a　b c \n"))) == "a b c"
    assert one(T.half_width(F.lit("２０２６：１２ー"))) == "2026:12-"


@pytest.mark.parametrize(
    "text, as_of, want",
    [
        ("2/10(火)〜2/15(日)", dt.date(2026, 6, 1), ("2026-02-10", "2026-02-15")),
        ("1/5", dt.date(2026, 12, 1), ("2027-01-05", "2027-01-05")),
        ("12/31〜1/2", dt.date(2026, 6, 1), ("2026-12-31", "2027-01-02")),
        ("２０２６年２月１０日", dt.date(2020, 1, 1), ("2026-02-10", "2026-02-10")),
        ("none", dt.date(2026, 6, 1), None),
    ],
)
def test_date_range(one, text, as_of, want):
    got = one(D.date_range(F.lit(text), as_of))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("text, want", [("2024-02-30", None), ("2024-2-3", None), ("2024-02-29", dt.date(2024, 2, 29))])
def test_strict_date(one, text, want):
    assert one(D.strict_date(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("12/01", dt.date(2026, 12, 1)), ("05/31", dt.date(2027, 5, 31)), ("10/31", None), ("2026-2-3", dt.date(2026, 2, 3)), ("x", None)])
def test_completed_date(one, text, want):
    assert one(D.completed_date(F.lit(text), dt.date(2026, 11, 26))) == want


@pytest.mark.parametrize("month, now, want", [(3, 10, 1), (10, 3, -1), (6, 6, 0)])
def test_target_year(one, month, now, want):
    assert one(D.target_year(F.lit(month), dt.date(2026, now, 1))) == 2026 + want


@pytest.mark.parametrize("text, want", [("午後1時30分", "13:30"), ("午前12時", "00:00"), ("午後12時", "12:00"), ("1時", None)])
def test_kanji_clock(one, text, want):
    assert one(D.kanji_clock(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("18:00", 1080), ("9:05", 545), ("18時", None)])
def test_minutes(one, text, want):
    assert one(D.minutes(F.lit(text))) == want


@pytest.mark.parametrize("a, b, want", [("2026-06-01", "2026-06-05", False), ("2026-06-05", "2026-06-06", True), ("2026-06-06", "2026-06-01", True), ("2026-06-08", "2026-06-01", False), ("2026-06-08", None, False)])
def test_weekend(one, a, b, want):
    assert one(D.includes_weekend(F.to_date(F.lit(a)), F.to_date(F.lit(b)))) == want


@pytest.mark.parametrize("url, want", [("https://x.jp/event/123/", True), ("https://x.jp/event/", False), ("https://x.jp/event/page/2/", False), ("https://x.jp/event_cat/x/event/1/", False), ("::bad", False)])
def test_event_url(one, url, want):
    assert one(U.is_event_detail(F.lit(url))) == want


@pytest.mark.parametrize("rate, want", [(0.01, "ok"), (0.0101, "warn"), (0.03, "warn"), (0.0301, "fail")])
def test_rate(one, rate, want):
    assert one(V.rate_status(F.lit(rate))) == want


def test_tags(one):
    assert one(G.event_type(F.lit("高松市 音楽会"), F.lit(None))) == "festival"
    assert one(G.genres(F.lit("親子 美術 花 まつり"))) == ["art", "kids"]
    none = F.lit(None).cast("string")
    assert one(G.flags(F.lit("先着 完売"), F.lit("500円"), F.lit("18:00"), none, F.lit("2026-06-01"), none)) == ["limited", "paid"]


def test_labels(one):
    lines = F.array(F.lit("日時：6月"), F.lit("会場"), F.lit("ホール"))
    assert one(T.labeled_value(lines, ["会場", "日時"])) == "6月"
    assert one(T.labeled_value(lines, ["会場"])) == "ホール"
    assert one(T.labeled_value(lines, ["料金"])) == ""
    assert one(T.normalize_price(F.lit("詳細はこちら"))) is None


def test_relative_urls(one):
    assert one(U.resolve(F.lit("../a?b"), F.lit("https://x.jp/c/d/"))) == "https://x.jp/c/a?b"


def test_errors(one):
    assert one(V.error_type(F.lit("HTTP 404"))) == "NETWORK"
    assert one(V.error_type(F.lit("?"))) is None


def test_parts_with_year_come_first(one):
    assert one(D.date_parts(F.lit("3月4日 2026年1月2日"))) == ["2026-1-2", "3-4"]
    assert one(D.labelled_time(F.lit("18:00開場 開演 18:30"), "開演")) == "18:30"
