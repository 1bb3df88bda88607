"""Dates and times as columns.  Whatever depends on today takes ``as_of``; nothing reads the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import once

# Weekday signs from Sunday on; rules of year completion; minutes after which it is night.
WEEKDAYS = ["日", "月", "火", "水", "木", "金", "土"]
ROLL_FROM, ROLL_TO = 11, 2
NIGHT = 18 * 60


def strict_date(text: Column) -> Column:
    """A date from exactly YYYY-MM-DD, null otherwise or if there is no such day."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def lenient_day(text: Column) -> Column:
    """A day as browsers read it: a year, with a month and a day or without, which count as the first; days beyond their
    month's end run on into the next, up to the 31st.  Anything else is null."""
    form = r"^(\d{4})(?:-(0[1-9]|1[0-2])(?:-(0[1-9]|[12]\d|3[01]))?)?$"
    t = F.trim(text)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, form, i), F.lit("")).cast("int"), F.lit(1))
    return F.when(t.rlike(form), F.date_add(F.try_to_date(F.concat_ws("-", F.substring(t, 1, 4), F.lpad(part(2).cast("string"), 2, "0"), F.lit("01"))), part(3) - 1))


def make_date(y: Column, m: Column, d: Column) -> Column:
    """Null where there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def date_range(text: Column, as_of: dt.date) -> Column:
    """``struct(date_from, date_to)`` as ISO text from Japanese or slashed dates; null if there is none.

    The first match begins and the last ends.  A date without a year has that of ``as_of``, or the next one if
    ``as_of`` is in November or December and the month is January or February.  An end before the start whose year
    is not written moves to the year after the start's.  Days are not checked against the calendar.
    """
    clean = F.translate(text, "０１２３４５６７８９", "0123456789")
    clean = F.regexp_replace(clean, "[(（][月火水木金土日][)）]", "")
    clean = F.regexp_replace(F.regexp_replace(clean, "[年月]", "/"), "日", "")
    found = F.regexp_extract_all(clean, F.lit(r"((?:\d{4}/)?\d{1,2}/\d{1,2})"), F.lit(1))

    def parse(x: Column) -> tuple[Column, Column]:
        parts = F.split(x, "/")
        full = F.size(parts) == 3
        month, day = F.when(full, F.get(parts, 1)).otherwise(F.get(parts, 0)), F.when(full, F.get(parts, 2)).otherwise(F.get(parts, 1))
        year = F.when(full, F.get(parts, 0).cast("int")).otherwise(F.lit(as_of.year) + F.when((F.lit(as_of.month) >= ROLL_FROM) & (month.cast("int") <= ROLL_TO), 1).otherwise(0))
        return year, F.concat_ws("-", F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

    first, last = F.get(found, 0), F.get(found, F.size(found) - 1)
    y0, md0 = parse(first)
    y1, md1 = parse(last)
    start, end = F.concat_ws("-", y0.cast("string"), md0), F.concat_ws("-", y1.cast("string"), md1)
    end = F.when((end < start) & ~last.rlike(r"^\d{4}/"), F.concat_ws("-", (y0 + 1).cast("string"), md1)).otherwise(end)
    return F.when(F.size(found) > 0, F.struct(start.alias("date_from"), end.alias("date_to")))


def normalize_date_text(text: Column, *, drop_parens: bool = False, range_words: bool = False, commas: bool = False) -> Column:
    out = F.translate(text, "０１２３４５６７８９", "0123456789")
    if drop_parens:
        out = F.regexp_replace(out, "[（(][^）)]*[）)]", " ")
    out = F.translate(out, "／．〜～－–—", "/.~~---")
    if range_words:
        out = F.regexp_replace(out, "から|まで", "~")
    if commas:
        out = F.translate(out, "、，", ",,")
    from .text import normalize_space

    return normalize_space(out)


def date_parts(text: Column) -> Column:
    """Every date of a text as ``YYYY-M-D`` or ``M-D``: those with a year first, wherever they stand.  A year's date may
    have slashes or dots for its signs."""
    full = r"\d{4}\s*[年/.]\s*\d{1,2}\s*[月/.]\s*\d{1,2}\s*日?"
    with_year = F.transform(F.regexp_extract_all(text, F.lit(f"({full})"), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s日]", ""), "[年月/.]", "-"))
    rest = F.regexp_replace(text, full, " ")
    short = F.transform(F.regexp_extract_all(rest, F.lit(r"(\d{1,2}\s*月\s*\d{1,2}\s*日)"), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s日]", ""), "月", "-"))
    return F.concat(with_year, short)


def completed_date(text: Column, as_of: dt.date, months_ahead: int = 6) -> Column:
    """Full dates as they are; month and day alone only if exactly one year puts them into the window from the first
    of this month to the end of the month ``months_ahead`` on."""
    t = F.trim(text)
    y, m, d = (F.regexp_extract(t, r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$", i) for i in (1, 2, 3))
    month, day = (F.regexp_extract(t, r"^(\d{1,2})[/-](\d{1,2})$", i) for i in (1, 2))
    start = as_of.replace(day=1)
    end = F.last_day(F.add_months(F.lit(start), months_ahead))
    tries = [F.when(month != "", make_date(F.lit(as_of.year + k), month, day)) for k in (0, 1)]
    fits = [F.coalesce(x.between(F.lit(start), end), F.lit(False)) for x in tries]
    short = F.when(fits[0] & ~fits[1], tries[0]).when(fits[1] & ~fits[0], tries[1])
    return F.when(y != "", make_date(y, m, d)).otherwise(short)


def this_year(text: Column, as_of: dt.date) -> Column:
    """Month and day of a text in the year of ``as_of``, without rolling over."""
    month, day = (F.regexp_extract(text, r"(\d{1,2})\s*[月/.]\s*(\d{1,2})", i) for i in (1, 2))
    return F.when(month != "", make_date(F.lit(as_of.year), month, day))


def target_year(month: Column, as_of: dt.date) -> Column:
    """The year a listing in spring or autumn means: next from October on for January to March, and the reverse."""
    return F.lit(as_of.year) + F.when((F.lit(as_of.month) >= 10) & (month <= 3), 1).when((F.lit(as_of.month) <= 3) & (month >= 10), -1).otherwise(0)


def single_date(text: Column) -> Column:
    """The first full date in Japanese, slashed or dotted form."""
    day = lambda p: make_date(F.get(p, 0), F.get(p, 1), F.get(p, 2))
    return once(F.regexp_extract(text, r"\d{4}\s*[年/.]\s*\d{1,2}\s*[月/.]\s*\d{1,2}", 0), lambda t: F.when(t != "", once(F.split(t, r"\s*[年月/.]\s*"), day)))


def compact_date(text: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"(\d{8})", 1), F.lit("")), "yyyyMMdd")


def day_range_in_month(text: Column, year: Column, month: Column) -> Column:
    """``struct(date_from, date_to)`` of day numbers under a page's month, as in ``5(火)～7(木)``."""
    days = F.regexp_extract_all(text, F.lit(r"(\d{1,2})\s*[(（]"), F.lit(1))
    return F.when(F.size(days) > 0, F.struct(make_date(year, month, F.get(days, 0)).alias("date_from"), make_date(year, month, F.get(days, F.size(days) - 1)).alias("date_to")))


def minutes(text: Column) -> Column:
    """Minutes of exactly H:MM; hours are not checked."""
    h, m = (F.regexp_extract(text, r"^(\d{1,2}):(\d{2})$", i) for i in (1, 2))
    return F.when(h != "", h.cast("int") * 60 + m.cast("int"))


def clock(text: Column) -> Column:
    """The first valid time of day as HH:MM, null otherwise."""
    padded = F.lpad(F.regexp_extract(text, r"\d{1,2}:\d{2}", 0), 5, "0")
    return once(padded, lambda t: F.when((F.left(t, F.lit(2)) <= "23") & (F.right(t, F.lit(2)) <= "59") & t.contains(":"), t))


def kanji_clock(text: Column) -> Column:
    """午前 and 午後 times as HH:MM; minutes default to 00."""
    half, h, m = (F.regexp_extract(text, r"(午前|午後)\s*(\d{1,2})時(?:(\d{1,2})分)?", i) for i in (1, 2, 3))
    hour = F.try_to_number(h, F.lit("99")).cast("int")
    hour = F.when((half == "午後") & (hour < 12), hour + 12).when((half == "午前") & (hour == 12), 0).otherwise(hour)
    return F.when(half != "", F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), F.lpad(F.when(m == "", "00").otherwise(m), 2, "0")))


def labelled_time(text: Column, label: str) -> Column:
    """A time before or after its label, as in 開演18:30 or 18:30開演."""
    from .text import first_capture

    return F.coalesce(clock(first_capture(text, rf"{label}\s*[:：／/]?\s*(\d{{1,2}}:\d{{2}})")), clock(first_capture(text, rf"(\d{{1,2}}:\d{{2}})\s*{label}")))


def includes_weekend(first: Column, last: Column, limit: int = 90) -> Column:
    """Whether a Saturday or Sunday falls into the range, looking ``limit`` days ahead; only the first day if the end
    comes before it."""
    end = F.coalesce(last, first)
    span = F.least(F.greatest(F.datediff(end, first), F.lit(0)), F.lit(limit))
    to_saturday = (F.lit(7) - F.dayofweek(first)) % 7  # Sunday is 1
    return F.coalesce((F.dayofweek(first) == 1) | (to_saturday <= span), F.lit(False))


def weekday_label(d: Column) -> Column:
    return F.get(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(d) - 1)


def long_label(d: Column) -> Column:
    return F.concat(F.date_format(d, "yyyy年MM月dd日"), F.lit("（"), weekday_label(d), F.lit("）"))


def range_label(first: Column, last: Column) -> Column:
    a, b = F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd")
    return F.when((a == b) | b.isNull(), a).otherwise(F.concat_ws("〜", a, b))


def local_today(ts: Column, zone: str = "Asia/Tokyo") -> Column:
    """The calendar day of a UTC timestamp in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))
