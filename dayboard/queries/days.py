"""Dated listings: days, windows, neighbours, buckets, ranges."""

from __future__ import annotations

from ..functions import dates
from ..operators import events as ev
from ..operators import ranking
from .base import AS_OF, EVENTS_AS_OF, EXPANDED, ORDERS, F, order_events, table


def _days(spark, sf):
    return ev.expand_days(order_events(spark, sf), window=ev.publish_window(AS_OF))


def event_day_expand_count(spark, sf):
    return _days(spark, sf).groupBy("day").agg(F.count("*").alias("n_events"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _dirty(spark, sf):
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("date_to"))
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date_from"))
    return o.join(last, o.o_orderkey == last.l_orderkey).drop("l_orderkey")


def dirty_range_clamp(spark, sf):
    days = ev.expand_days(ev.sane_range(_dirty(spark, sf)), window=ev.publish_window(AS_OF))
    return days.groupBy("day").agg(F.count("*").alias("n_events"))


def range_sanity_counts(spark, sf):
    kind = F.when(F.col("date_to") < F.col("date_from"), "inverted").when(F.datediff("date_to", "date_from") > 365, "too_long").otherwise("clean")
    return _dirty(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def day_top3(spark, sf):
    top = ranking.top_per_group(_days(spark, sf), ["day"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return top.join(cust, "o_custkey", "left").select("day", "position", "o_orderkey", F.coalesce("c_name", F.col("o_custkey").cast("string")).alias("label"))


def day_prev_next(spark, sf):
    return ranking.neighbours(_days(spark, sf), "day")


def day_noindex_flag(spark, sf):
    counts = _days(spark, sf).groupBy("day").agg(F.count("*").alias("n_events"))
    return counts.withColumn("noindex", ev.noindex(F.col("day"), F.col("n_events"), AS_OF))


def index_window_121(spark, sf):
    days = _days(spark, sf).where(F.col("day") >= F.lit(AS_OF)).groupBy("day").agg(F.count("*").alias("n_events"))
    return days.orderBy("day").limit(121)


def past_cutoff_reason(spark, sf):
    o = order_events(spark, sf)
    text = F.when(F.col("o_orderkey") % 10 == 0, "").when(F.col("o_orderkey") % 10 == 1, "1998-13-01").otherwise(F.date_format("date_to", "yyyy-MM-dd"))
    reason = ev.retention_reason(F.lit(""), text, AS_OF)
    return o.select("o_orderkey", reason.alias("reason"), ev.keep_reason(reason, keep_missing=True, keep_invalid=True).alias("keep"))


def held_on_day(spark, sf):
    o = order_events(spark, sf).where(ev.held_on(F.col("date_from"), F.col("date_to"), AS_OF))
    return o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "date_from", "date_to")


def status_buckets(spark, sf):
    b = ev.status_bucket(F.col("date_from"), F.col("date_to"), AS_OF)
    return order_events(spark, sf).agg(*[F.count_if(b == k).alias(k) for k in ("ongoing", "upcoming", "past")])


def bucket_top20(spark, sf):
    o = order_events(spark, sf).withColumn("bucket", ev.status_bucket(F.col("date_from"), F.col("date_to"), AS_OF))
    day = F.datediff(F.col("date_from"), F.lit("1970-01-01").cast("date"))
    order = [F.when(F.col("bucket") == "past", -day).otherwise(day).asc_nulls_last(), F.asc("o_orderkey")]
    return ranking.top_per_group(o, ["bucket"], order, 20).select("bucket", "position", "o_orderkey", "date_from")


def month_window(spark, sf):
    o = order_events(spark, sf).where(ev.month_window(F.col("date_from"), AS_OF))
    return o.groupBy(F.trunc("date_from", "month").alias("month")).agg(F.count("*").alias("n"))


def month_overlap(spark, sf):
    months = order_events(spark, sf).select(F.trunc("date_from", "month").alias("month")).distinct()
    return months.where(ev.month_overlaps(F.col("month"), *ev.publish_window(AS_OF, 90)))


def published_semi(spark, sf):
    from ..operators.joins import published

    days = order_events(spark, sf).select(F.col("date_from").alias("day"), (F.col("o_orderstatus") == "O").alias("open"))
    return published(days.where("open").select("day").distinct(), days.where("not open").select("day").distinct(), "day")


def stale_anti(spark, sf):
    from ..operators.joins import stale

    o = order_events(spark, sf).select("o_custkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("urgent"))
    return stale(o.where("urgent").select("o_custkey").distinct(), o.where("not urgent").select("o_custkey").distinct(), "o_custkey")


def weekend_flag(spark, sf):
    return order_events(spark, sf).select("o_orderkey", dates.includes_weekend(F.col("date_from"), F.when(F.col("o_orderkey") % 4 > 0, F.date_add("date_from", (F.col("o_orderkey") % 4).cast("int")))).alias("weekend"))


def weekday_label(spark, sf):
    d = F.col("date_from")
    return order_events(spark, sf).select(d.alias("day"), dates.weekday_label(d).alias("weekday"), dates.long_label(d).alias("label")).distinct()


def range_label(spark, sf):
    return order_events(spark, sf).select("o_orderkey", dates.range_label(F.col("date_from"), F.col("date_to")).alias("label"))


def jp_date_range(spark, sf):
    """Ranges written as 12/31(土)～1/2, read back against the reference day."""
    o = order_events(spark, sf)
    text = F.concat(F.date_format("date_from", "M/d"), F.lit("(土)～"), F.date_format("date_to", "M/d"))
    return o.select("o_orderkey", dates.date_range(text, AS_OF).alias("r")).select("o_orderkey", "r.date_from", "r.date_to")


def completed_dates(spark, sf):
    o = order_events(spark, sf)
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("date_from", "yyyy/M/d")).otherwise(F.date_format("date_from", "M/d"))
    return o.select("o_orderkey", dates.completed_date(text, AS_OF).alias("d"))


def target_years(spark, sf):
    m = F.month("date_from")
    import datetime as dt

    return order_events(spark, sf).select(m.alias("month")).distinct().select("month", *[dates.target_year(F.col("month"), dt.date(1998, k, 1)).alias(f"seen_in_{k}") for k in (2, 6, 11)])


def night_flag(spark, sf):
    text = F.date_format("ts", "HH:mm")
    return table(spark, sf, "events").select("event_id", dates.minutes(text).alias("minute"), (dates.minutes(text) >= dates.NIGHT).alias("night"))


def local_day_counts(spark, sf):
    d = dates.local_today(F.col("ts"))
    return table(spark, sf, "events").groupBy(d.alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= F.lit(EVENTS_AS_OF)).alias("recent"))


def kanji_clock(spark, sf):
    e = table(spark, sf, "events")
    h = F.hour("ts")
    text = F.concat(F.when(h < 12, "午前").otherwise("午後"), (h % 12).cast("string"), F.lit("時"), F.minute("ts").cast("string"), F.lit("分"))
    return e.select("event_id", dates.kanji_clock(text).alias("clock"))


QUERIES = {f.__name__: f for f in (event_day_expand_count, dirty_range_clamp, range_sanity_counts, day_top3, day_prev_next, day_noindex_flag, index_window_121, past_cutoff_reason, held_on_day, status_buckets, bucket_top20, month_window, month_overlap, published_semi, stale_anti, weekend_flag, weekday_label, range_label, jp_date_range, completed_dates, target_years, night_flag, local_day_counts, kanji_clock)}

_DIRTY = "WITH x AS (SELECT o_orderkey, o_orderdate::DATE AS date_from, max(l_shipdate)::DATE AS date_to FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"
_BUCKET = "CASE WHEN date_from IS NULL THEN 'upcoming' WHEN date_from <= DATE '1998-06-15' AND DATE '1998-06-15' <= date_to THEN 'ongoing' WHEN date_from > DATE '1998-06-15' THEN 'upcoming' ELSE 'past' END"
_WEEKDAY = "['日','月','火','水','木','金','土'][dayofweek(date_from) + 1]"
_MD = "strftime({0}, '%-m/%-d')"
SQL = {
    "event_day_expand_count": EXPANDED + " SELECT d AS day, count(*) AS n_events, round(sum(o_totalprice), 2) AS total FROM day GROUP BY d",
    "dirty_range_clamp": _DIRTY + ", y AS (SELECT o_orderkey, date_from, CASE WHEN date_to - date_from > 365 THEN date_from ELSE date_to END AS date_to FROM x WHERE date_from <= date_to), z AS (SELECT unnest(generate_series(date_from, date_to, INTERVAL 1 DAY))::DATE AS day FROM y) SELECT day, count(*) AS n_events FROM z WHERE day BETWEEN DATE '1997-06-15' AND DATE '1999-06-15' GROUP BY day",
    "range_sanity_counts": _DIRTY + " SELECT CASE WHEN date_to < date_from THEN 'inverted' WHEN date_to - date_from > 365 THEN 'too_long' ELSE 'clean' END AS kind, count(*) AS n FROM x GROUP BY 1",
    "day_top3": EXPANDED + ", r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY o_totalprice DESC, o_orderkey) AS position FROM day) SELECT d AS day, position::INT AS position, o_orderkey, coalesce(c_name, o_custkey::VARCHAR) AS label FROM r LEFT JOIN customer ON c_custkey = o_custkey WHERE position <= 3",
    "day_prev_next": EXPANDED + ", k AS (SELECT DISTINCT d AS day FROM day) SELECT day, lag(day) OVER (ORDER BY day) AS prev_day, lead(day) OVER (ORDER BY day) AS next_day FROM k",
    "day_noindex_flag": EXPANDED + " SELECT d AS day, count(*) AS n_events, (d < DATE '1998-06-15' OR d > DATE '1998-06-15' + 120 OR count(*) = 0) AS noindex FROM day GROUP BY d",
    "index_window_121": EXPANDED + " SELECT d AS day, count(*) AS n_events FROM day WHERE d >= DATE '1998-06-15' GROUP BY d ORDER BY d LIMIT 121",
    "past_cutoff_reason": ORDERS + ", t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 10 = 1 THEN '1998-13-01' ELSE strftime(date_to, '%Y-%m-%d') END AS t FROM ev), r AS (SELECT o_orderkey, CASE WHEN t = '' THEN 'missing_date' WHEN try_cast(t AS DATE) IS NULL THEN 'invalid_date' WHEN t::DATE < DATE '1997-06-15' THEN 'expired' ELSE 'in_range' END AS reason FROM t) SELECT o_orderkey, reason, reason <> 'expired' AS keep FROM r",
    "held_on_day": ORDERS + " SELECT o_orderkey, c_name, date_from, date_to FROM ev JOIN customer ON c_custkey = o_custkey WHERE DATE '1998-06-15' BETWEEN date_from AND date_to",
    "status_buckets": ORDERS + f", b AS (SELECT {_BUCKET} AS b FROM ev) SELECT count(*) FILTER (WHERE b = 'ongoing') AS ongoing, count(*) FILTER (WHERE b = 'upcoming') AS upcoming, count(*) FILTER (WHERE b = 'past') AS past FROM b",
    "bucket_top20": ORDERS + f", b AS (SELECT *, {_BUCKET} AS bucket FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN bucket = 'past' THEN DATE '1970-01-01' - date_from ELSE date_from - DATE '1970-01-01' END, o_orderkey) AS position FROM b) SELECT bucket, position::INT AS position, o_orderkey, date_from FROM r WHERE position <= 20",
    "month_window": ORDERS + " SELECT date_trunc('month', date_from)::DATE AS month, count(*) AS n FROM ev WHERE date_from >= DATE '1998-06-01' AND date_from < DATE '1999-01-01' GROUP BY 1",
    "month_overlap": ORDERS + ", m AS (SELECT DISTINCT date_trunc('month', date_from)::DATE AS month FROM ev) SELECT month FROM m WHERE month <= DATE '1998-06-15' + 90 AND last_day(month) >= DATE '1998-06-15' - 90",
    "published_semi": ORDERS + " SELECT DISTINCT date_from AS day FROM ev WHERE o_orderstatus = 'O' AND date_from IN (SELECT date_from FROM ev WHERE o_orderstatus <> 'O')",
    "stale_anti": ORDERS + " SELECT DISTINCT o_custkey FROM ev e WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT EXISTS (SELECT 1 FROM ev f WHERE f.o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND f.o_custkey = e.o_custkey)",
    "weekend_flag": ORDERS + " SELECT o_orderkey, len(list_filter(generate_series(date_from, date_from + (o_orderkey % 4)::INT, INTERVAL 1 DAY), lambda d: dayofweek(d) IN (0, 6))) > 0 AS weekend FROM ev",
    "weekday_label": ORDERS + f" SELECT DISTINCT date_from AS day, {_WEEKDAY} AS weekday, concat(strftime(date_from, '%Y年%m月%d日'), '（', {_WEEKDAY}, '）') AS label FROM ev",
    "range_label": ORDERS + " SELECT o_orderkey, CASE WHEN date_from = date_to THEN strftime(date_from, '%Y-%m-%d') ELSE concat(strftime(date_from, '%Y-%m-%d'), '〜', strftime(date_to, '%Y-%m-%d')) END AS label FROM ev",
    "jp_date_range": ORDERS + " SELECT o_orderkey, strftime(date_from, '1998-%m-%d') AS date_from, CASE WHEN strftime(date_to, '%m-%d') < strftime(date_from, '%m-%d') THEN strftime(date_to, '1999-%m-%d') ELSE strftime(date_to, '1998-%m-%d') END AS date_to FROM ev",
    "completed_dates": ORDERS + ", t AS (SELECT o_orderkey, date_from, try_cast(strftime(date_from, '1998-%m-%d') AS DATE) AS a, try_cast(strftime(date_from, '1999-%m-%d') AS DATE) AS b FROM ev) SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN date_from WHEN coalesce(a BETWEEN DATE '1998-06-01' AND DATE '1998-12-31', false) THEN a WHEN coalesce(b BETWEEN DATE '1998-06-01' AND DATE '1998-12-31', false) THEN b END AS d FROM t",
    "target_years": ORDERS + ", m AS (SELECT DISTINCT month(date_from)::INT AS month FROM ev) SELECT month, (1998 + CASE WHEN month >= 10 THEN -1 ELSE 0 END)::INT AS seen_in_2, 1998::INT AS seen_in_6, (1998 + CASE WHEN month <= 3 THEN 1 ELSE 0 END)::INT AS seen_in_11 FROM m",
    "night_flag": "SELECT event_id, (hour(ts) * 60 + minute(ts))::INT AS minute, hour(ts) >= 18 AS night FROM events",
    "local_day_counts": "SELECT (ts + INTERVAL 9 HOUR)::DATE AS day, count(*) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20') AS recent FROM events GROUP BY 1",
    "kanji_clock": "SELECT event_id, strftime(ts, '%H:%M') AS clock FROM events",
}
