"""Extraction and composed joins on stand-in texts."""

from __future__ import annotations

from ..functions import extract, text
from ..operators import joins, ranking, stats
from .base import ORDERS, F, order_events, table
from .columns import _plain


def _jp(d):
    return F.date_format(d, "yyyy年M月d日")


def implied_end_ranges(spark, sf):
    o = order_events(spark, sf)
    t = F.concat(_jp("date_from"), F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise("～"), F.date_format("date_to", "M月d日"))
    return o.select("o_orderkey", extract.implied_end_range(t).alias("r")).select("o_orderkey", "r.date_from", "r.date_to")


def split_ranges(spark, sf):
    o = order_events(spark, sf)
    t = F.concat(F.col("date_from").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" 〜 "), F.col("date_to").cast("string"))).otherwise(""))
    return o.select("o_orderkey", extract.split_range(t).alias("r")).select("o_orderkey", "r.start", "r.end")


def time_ranges(spark, sf):
    e = table(spark, sf, "events")
    t = F.concat(F.date_format("ts", "H:mm"), F.lit("～"), F.when(F.col("event_id") % 5 == 0, "25:00").otherwise("21:30"))
    return e.select("event_id", extract.time_range(t).alias("r")).select("event_id", "r.start", "r.end")


def slash_keys(spark, sf):
    t = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("date_from", "yyyy/M/d")).otherwise(F.date_format("date_from", "yyyy/MM/dd"))
    return order_events(spark, sf).select("o_orderkey", extract.slash_key(t).alias("iso"))


def title_cleaning(spark, sf):
    t = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "【終了】 ").otherwise(""), F.date_format("date_from", "M月d日"), F.lit("(土) Show "), F.col("o_orderkey").cast("string"))
    return order_events(spark, sf).select("o_orderkey", extract.clean_title(t).alias("title"))


def place_residue(spark, sf):
    t = F.concat(_jp("date_from"), F.lit("（土） 18:30～ Hall "), (F.col("o_custkey") % 10).cast("string"))
    return order_events(spark, sf).select("o_orderkey", extract.residue(t).alias("place"))


def page_sections(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(extract.section(F.col("html"), "<article>", ["</article>", "<footer>"])).alias("digest"), extract.context(F.col("html"), "<h1>", 30, 40).alias("around"))


def fallback_titles(spark, sf):
    labelled = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("L"), F.col("page_id").cast("string"))).otherwise("")
    return table(spark, sf, "pages").select("page_id", extract.fallback_title(F.col("html"), labelled).alias("title"))


def auto_links(spark, sf):
    t = F.concat(F.lit("see "), F.col("url"), F.lit(". and https://e.org/x, end"))
    return table(spark, sf, "pages").select("page_id", F.array_join(extract.auto_links(t), " ").alias("links"))


def organizers(spark, sf):
    """Organisers beside or below their label, up to the next label; addresses are none."""
    t = F.concat(F.lit("日時：6月\n"), F.when(F.col("p_partkey") % 2 == 0, "企画・主催：").otherwise("主催者\n"), F.when(F.col("p_partkey") % 3 == 0, "a@b.jp").otherwise(F.concat("p_brand", F.lit("　連絡先：x"))), F.lit("\n出演\n"), F.when(F.col("p_partkey") % 5 == 0, "www.x.jp").otherwise(F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", extract.organizer(t).alias("organizer"), extract.performer(t).alias("performer"))


def descriptions(spark, sf):
    k = F.col("p_partkey")
    t = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.concat("p_name", F.lit("、"))).otherwise(F.repeat("p_name", 10))
    area = F.when(k % 2 == 0, F.lit("香川県"))
    return table(spark, sf, "part").select("p_partkey", extract.description(t, F.col("p_brand"), prefecture=area, municipality=F.when(k % 4 == 0, "高松市"), category=F.when(k % 5 > 0, F.col("p_type"))).alias("description"))


def exclusion_filter(spark, sf):
    t = F.get(F.array(F.lit("休館日"), F.lit(" 　"), F.lit("コンサート"), F.lit("展示（関係者のみ）"), F.lit(None).cast("string")), (F.col("o_orderkey") % 5).cast("int"))
    return order_events(spark, sf).agg(F.count_if(extract.is_excluded(t)).alias("excluded"), F.count_if(~extract.is_excluded(t)).alias("kept"))


def list_with_details(spark, sf):
    """A list joined to details: titles from the list first, dates from the details first."""
    o = order_events(spark, sf)
    listed = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("title"), "date_from")
    detail = o.select(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey")).otherwise(-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lower("o_orderpriority").alias("d_title"), F.when(F.col("o_orderkey") % 5 > 0, F.col("date_to")).alias("d_date"))
    return listed.join(detail, "o_orderkey", "left").select("o_orderkey", F.coalesce("title", "d_title").alias("title"), F.coalesce("d_date", "date_from").alias("day"))


def spot_events(spark, sf):
    """Venues with their first events as one text; none is empty."""
    top = ranking.top_per_group(order_events(spark, sf), ["o_custkey"], [F.asc("date_from"), F.asc("o_orderkey")], 3)
    grouped = top.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("position", "o_orderkey"))).alias("e"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return c.join(grouped, "o_custkey", "left").select("c_name", F.coalesce(F.array_join(F.col("e.o_orderkey").cast("array<string>"), ","), F.lit("")).alias("events"))


def latest_change(spark, sf):
    """Pages with the later of their own change and that of their events."""
    own = table(spark, sf, "pages").select("page_id", F.date_add(F.lit("2024-01-05").cast("date"), (F.col("page_id") % 20).cast("int")).alias("own"))
    seen = table(spark, sf, "events").groupBy(F.col("user_id").alias("page_id")).agg(F.max(F.to_date("ts")).alias("seen"))
    return own.join(seen, "page_id", "left").select("page_id", F.greatest("own", "seen").alias("lastmod"))


def grand_total(spark, sf):
    counts = joins.with_counts(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey")
    return counts.groupBy("s_nationkey").agg(F.sum("n_events").alias("n")).agg(F.count("*").alias("n_nations"), F.sum("n").alias("total"))


def bucket_pivot(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["view", "click", "purchase", "absent"]).agg(F.count("event_id")).fillna(0)


def first_rule_order(spark, sf):
    """The first tag rule in order decides, not the best."""
    from ..functions.tags import first_rule

    t = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf, "part").groupBy(first_rule(F.lower(t), {"steel": ["steel"], "blue": ["blue"], "any": ["e"]}).alias("rule")).agg(F.count("*").alias("n"))


def quality_totals(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    gate = stats.quality_gate(d, ["source"], F.col("text"), F.col("quality").isNotNull(), warn=0.55, fail=0.62)
    return gate.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "fail")])


def zero_width_and_blank(spark, sf):
    t = F.when(F.col("p_partkey") % 4 == 0, "​ 　").otherwise(F.concat(F.col("p_name"), F.lit("‍")))
    return table(spark, sf, "part").select("p_partkey", text.remove_zero_width(t).alias("t"), text.is_blank(text.remove_zero_width(t)).alias("blank"))


QUERIES = {f.__name__: f for f in (implied_end_ranges, split_ranges, time_ranges, slash_keys, title_cleaning, place_residue, page_sections, fallback_titles, auto_links, organizers, descriptions, exclusion_filter, list_with_details, spot_events, latest_change, grand_total, bucket_pivot, first_rule_order, quality_totals, zero_width_and_blank)}

_TAGS = ", ".join("nullif(" + _plain(rf"regexp_extract(html, '(?is)<{t}(?:\s[^>]*)?>(.*?)</{t}>', 1)") + ", '')" for t in ("h1", "h2", "h3"))
SQL = {
    "implied_end_ranges": ORDERS + ", t AS (SELECT o_orderkey, date_from, try_cast(concat(year(date_from), strftime(date_to, '-%m-%d')) AS DATE) AS e FROM ev WHERE TRUE) SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 AND e IS NOT NULL THEN date_from END AS date_from, CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN e < date_from THEN (e + INTERVAL 1 YEAR)::DATE ELSE e END END AS date_to FROM t",
    "split_ranges": ORDERS + " SELECT o_orderkey, date_from::VARCHAR AS start, CASE WHEN o_orderkey % 2 = 0 THEN date_to::VARCHAR ELSE date_from::VARCHAR END AS \"end\" FROM ev",
    "time_ranges": "SELECT event_id, strftime(ts, '%H:%M') AS start, CASE WHEN event_id % 5 > 0 THEN '21:30' END AS \"end\" FROM events",
    "slash_keys": ORDERS + " SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 OR (month(date_from) > 9 AND day(date_from) > 9) THEN date_from::VARCHAR END AS iso FROM ev",
    "title_cleaning": "SELECT o_orderkey, concat('Show ', o_orderkey) AS title FROM orders",
    "place_residue": "SELECT o_orderkey, concat('Hall ', o_custkey % 10) AS place FROM orders",
    "page_sections": "SELECT page_id, md5(string_split(string_split(substr(html, strpos(html, '<article>') + 9), '</article>')[1], '<footer>')[1]) AS digest, substr(html, strpos(html, '<h1>') - 30, 70) AS around FROM pages",
    "fallback_titles": f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('L', page_id) ELSE coalesce({_TAGS}, CASE WHEN length({_plain('html')}) > 60 THEN concat(left({_plain('html')}, 60), '…') ELSE {_plain('html')} END) END AS title FROM pages",
    "auto_links": r"SELECT page_id, concat(regexp_replace(url, '[.,;:!?。、]+$', ''), ' https://e.org/x') AS links FROM pages",
    "organizers": "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS organizer, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS performer FROM part",
    "descriptions": """WITH d AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN concat(p_name, '、') WHEN 2 THEN repeat(p_name, 10)
        ELSE concat(CASE WHEN p_partkey % 4 = 0 THEN '香川県 高松市' WHEN p_partkey % 2 = 0 THEN '香川県' ELSE '四国' END, 'にある', CASE WHEN p_partkey % 5 > 0 THEN concat(p_type, 'の') END, p_brand, 'の施設詳細ページです。開催予定のイベントやアクセス情報を確認できます。') END AS t FROM part)
      SELECT p_partkey, CASE WHEN t LIKE '%、' OR t LIKE '%。' OR length(t) < 60 THEN concat(t, ' 公式サイトや開催予定イベント、アクセス情報への導線をこのページでまとめて確認できます。') ELSE t END AS description FROM d""",
    "exclusion_filter": "SELECT count(*) FILTER (WHERE o_orderkey % 5 <> 2) AS excluded, count(*) FILTER (WHERE o_orderkey % 5 = 2) AS kept FROM orders",
    "list_with_details": ORDERS + " SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority WHEN o_orderkey % 4 > 0 THEN lower(o_orderpriority) END AS title, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 5 > 0 THEN date_to ELSE date_from END AS day FROM ev",
    "spot_events": ORDERS + ", r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY date_from, o_orderkey) AS p FROM ev), g AS (SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY p) AS e FROM r WHERE p <= 3 GROUP BY 1) SELECT c_name, coalesce(e, '') AS events FROM customer LEFT JOIN g ON o_custkey = c_custkey",
    "latest_change": "WITH s AS (SELECT user_id AS page_id, max(ts::DATE) AS seen FROM events GROUP BY 1) SELECT page_id, greatest(DATE '2024-01-05' + (page_id % 20)::INT, coalesce(seen, DATE '2000-01-01')) AS lastmod FROM pages LEFT JOIN s USING (page_id)",
    "grand_total": "SELECT count(DISTINCT s_nationkey) AS n_nations, (SELECT count(*) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)::BIGINT AS total FROM supplier",
    "bucket_pivot": "SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type = 'view') AS \"view\", count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, 0::BIGINT AS absent FROM events GROUP BY 1",
    "first_rule_order": "SELECT CASE WHEN contains(t, 'steel') THEN 'steel' WHEN contains(t, 'blue') THEN 'blue' WHEN contains(t, 'e') THEN 'any' ELSE 'other' END AS rule, count(*) AS n FROM (SELECT lower(concat(p_name, ' ', p_type)) AS t FROM part) GROUP BY 1",
    "quality_totals": "WITH g AS (SELECT source, count(*) FILTER (WHERE quality IS NULL) / count(*) AS r FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) SELECT count(*) FILTER (WHERE r <= 0.55) AS ok, count(*) FILTER (WHERE r > 0.55 AND r <= 0.62) AS warn, count(*) FILTER (WHERE r > 0.62) AS fail FROM g",
    "zero_width_and_blank": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN concat(' ', chr(12288)) ELSE p_name END AS t, p_partkey % 4 = 0 AS blank FROM part",
}
