"""Joins, aggregates, windows, duplicates, iteration."""

from __future__ import annotations

from pyspark.sql import Window

from ..operators import dedupe, graph, joins, ranking, stats
from .base import AS_OF, ORDERS, F, order_events, table


def venue_event_count(spark, sf):
    facts = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    return joins.with_counts(table(spark, sf, "supplier").select("s_suppkey", "s_name"), facts, "s_suppkey")


def prefecture_rollup(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.rollup("r_name").agg(F.count("*").alias("n_spots"), F.round(F.sum("s_acctbal"), 2).alias("total"))


def fixed_list_summary(spark, sf):
    counts = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    return stats.over_fixed_list(spark, ["EUROPE", "ASIA", "ATLANTIS"], "r_name", counts, ["n"])


def dim_left_join_fallback(spark, sf):
    cust = table(spark, sf, "customer").select((F.col("c_custkey") + 3).alias("o_custkey"), F.col("c_name").alias("label"), "c_mktsegment")
    return joins.with_dimension(order_events(spark, sf).select("o_orderkey", "o_custkey"), cust, "o_custkey", "label", "o_custkey", ["c_mktsegment"]).drop("c_mktsegment")


def merge_sources_full_outer(spark, sf):
    o = order_events(spark, sf)
    left = o.select((F.col("o_orderkey") + 4).alias("o_orderkey"), "o_orderpriority", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("o_totalprice"))
    right = o.select("o_orderkey", F.lower("o_orderpriority").alias("o_orderpriority"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    prefer = {"o_orderpriority": F.col("l_o_orderpriority").startswith("1")}
    return joins.merge_sources(left, right, ["o_orderkey"], ["o_orderpriority", "o_totalprice"], prefer)


def owner_conflicts(spark, sf):
    return joins.owner_conflicts(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


def adjacent_rows(spark, sf):
    out = joins.with_next(table(spark, sf, "conversations"), ["conv_id"], ["turn"], ["role"])
    return out.select("conv_id", "turn", "role", "next_role", "prev_role")


def stat_diff(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    after = p.withColumn("p_partkey", F.when(F.col("p_partkey") % 7 == 0, -F.col("p_partkey")).otherwise(F.col("p_partkey")))
    after = after.withColumn("p_size", F.when(F.col("p_partkey") % 11 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return joins.stat_changes(p, after, "p_partkey", ["p_size", "p_retailprice"])


def dedupe_first(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return dedupe.keep_first(e, ["user_id", "event_type"], "event_id")


def dedupe_last(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return dedupe.keep_last_at_first(e, ["user_id", "event_type"], "event_id")


def dedupe_prefer(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return dedupe.keep_preferred(e, ["user_id"], F.col("event_type") == "view", "event_id")


def dedupe_composite_nulls(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("user_id") % 4 > 0, F.col("user_id")).alias("user_id"), "event_type", F.to_date("ts").alias("day"), "event_id")
    return dedupe.keep_first(e, ["user_id", "event_type", "day"], "event_id")


def dedupe_texts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    return dedupe.keep_first(d, ["text"], "doc_id", drop_blank=True).select("doc_id", "source")


def repeated_ids(spark, sf):
    return dedupe.repeated_keys(table(spark, sf, "events").select("user_id", "event_type", F.hour("ts").alias("hour")), ["user_id", "event_type", "hour"])


def union_sources(spark, sf):
    a = order_events(spark, sf).select("o_orderkey", "o_orderstatus")
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("o_orderpriority"))
    return dedupe.union_sources(a, b).groupBy("source_ord").agg(F.count("*").alias("n"), F.count("o_orderstatus").alias("with_status"), F.count("o_orderpriority").alias("with_priority"))


def type_histogram(spark, sf):
    return stats.histogram(table(spark, sf, "events"), "event_type", "event_id").select("event_type", "n", "first_seen")


def spot_top10(spark, sf):
    return ranking.top_per_group(order_events(spark, sf), ["o_custkey"], [F.col("date_from").asc_nulls_first(), F.asc("o_orderkey")], 10).select("o_custkey", "position", "o_orderkey", "date_from")


def page_offset(spark, sf):
    return ranking.page(table(spark, sf, "customer").select("c_custkey", "c_name"), [F.asc("c_name"), F.asc("c_custkey")], 20, 20)


def search_spots(spark, sf):
    return ranking.search(table(spark, sf, "customer"), "c_name", "00001").select("c_custkey", "c_name")


def search_suggestions(spark, sf):
    return ranking.suggestions(table(spark, sf, "customer"), "c_name", " 1 ", "c_custkey").select("c_custkey", "c_name")


def owners_not_allowed(spark, sf):
    """Parts with several suppliers, unless their suppliers' numbers are all even."""
    owned = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    return joins.owner_conflicts(owned, "l_partkey", "l_suppkey", owned.where("l_suppkey % 2 = 0"))


def name_order_ja(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").orderBy(ranking.ja("p_name"), "p_partkey")


def carry_forward(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("day_value"))
    out = ranking.carry_forward(e, ["user_id"], ["event_id"], F.col("event_type") == "view", ["day_value"])
    return out.select("user_id", "event_id", "segment", "day_value_filled")


def phase_segments(spark, sf):
    out = ranking.segments(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["event_id"], "event_type")
    return out.groupBy("user_id", "segment", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def length_budget(spark, sf):
    out = ranking.within_budget(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], "text", 1500)
    return out.select("conv_id", "turn", "used")


def segment_ends(spark, sf):
    """Where each event of a user ends: at the next one, or at the end of the month."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    end = F.coalesce(F.lead("ts").over(w), F.lit("2024-02-01").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.unix_timestamp(end).alias("end_s"))


def _edges(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100 + 1).alias("dst")).distinct()


def crawl_reach(spark, sf):
    start = table(spark, sf, "supplier").where("s_suppkey = 1").select(F.col("s_suppkey").alias("node"))
    return graph.crawl(start, _edges(spark, sf), 3)


def next_link_chain(spark, sf):
    """From every order to the next one of its customer, whose last leads back to the first: seven orders at most."""
    w = Window.partitionBy("o_custkey").orderBy("date_from", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = Window.partitionBy("o_custkey").orderBy("date_from", "o_orderkey")
    o = order_events(spark, sf).select("o_custkey", "o_orderkey", "date_from")
    links = o.select(F.col("o_orderkey").alias("src"), F.coalesce(F.lead("o_orderkey").over(ordered), F.first("o_orderkey").over(w)).alias("dst"))
    return graph.next_links(o.select(F.col("o_orderkey").alias("node")), links, 7)


def filter_summary_by_status(spark, sf):
    from ..operators.events import retention_reason

    keep = retention_reason(F.lit(""), F.date_format("date_to", "yyyy-MM-dd"), AS_OF) == "in_range"
    return stats.filter_summary(order_events(spark, sf), "o_orderstatus", keep)


def exclusion_counters(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count("*").alias("seen"), F.count_if(F.col("l_discount") == 0).alias("no_discount"), F.count_if(F.col("l_quantity") < 5).alias("small"), F.max(F.to_date("l_shipdate")).alias("latest"))


def date_bag(spark, sf):
    bag = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_linenumber") < 7, F.to_date("l_shipdate")).alias("d"))).alias("ds"))
    return bag.select("l_orderkey", stats.date_bag(F.col("ds.d")).alias("r")).select("l_orderkey", "r.date_from", "r.date_to")


QUERIES = {f.__name__: f for f in (venue_event_count, prefecture_rollup, fixed_list_summary, dim_left_join_fallback, merge_sources_full_outer, owner_conflicts, adjacent_rows, stat_diff, dedupe_first, dedupe_last, dedupe_prefer, dedupe_composite_nulls, dedupe_texts, repeated_ids, union_sources, type_histogram, spot_top10, page_offset, search_spots, search_suggestions, owners_not_allowed, name_order_ja, carry_forward, phase_segments, length_budget, segment_ends, crawl_reach, next_link_chain, filter_summary_by_status, exclusion_counters, date_bag)}

_FIRST = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM ({rows})) WHERE k = 1"
SQL = {
    "venue_event_count": "SELECT s_suppkey, s_name, count(l_suppkey) AS n_events FROM supplier LEFT JOIN (SELECT l_suppkey FROM lineitem) ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "prefecture_rollup": "SELECT r_name, count(*) AS n_spots, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)",
    "fixed_list_summary": "SELECT l.r_name, l.list_ord::INT AS list_ord, count(n_nationkey) AS n FROM (VALUES ('EUROPE', 0), ('ASIA', 1), ('ATLANTIS', 2)) l(r_name, list_ord) LEFT JOIN region r ON r.r_name = l.r_name LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL",
    "dim_left_join_fallback": "SELECT o_custkey, o_orderkey, coalesce(c_name, o_custkey::VARCHAR) AS label, coalesce(c_mktsegment, '') AS address FROM orders LEFT JOIN customer ON c_custkey + 3 = o_custkey",
    "merge_sources_full_outer": "WITH l AS (SELECT o_orderkey + 4 AS o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS t FROM orders), r AS (SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority, o_totalprice * 2 AS t FROM orders) SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, coalesce(CASE WHEN l.o_orderpriority LIKE '1%' THEN r.o_orderpriority END, l.o_orderpriority, r.o_orderpriority) AS o_orderpriority, coalesce(l.t, r.t) AS o_totalprice, CASE WHEN l.o_orderkey IS NULL THEN 'right' WHEN r.o_orderkey IS NULL THEN 'left' ELSE 'both' END AS side FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey",
    "owner_conflicts": "SELECT l_partkey, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
    "adjacent_rows": "SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lag(role) OVER w AS prev_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "stat_diff": "WITH b AS (SELECT p_partkey, p_size, p_retailprice FROM part), a AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN -p_partkey ELSE p_partkey END AS p_partkey, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_retailprice FROM part) SELECT coalesce(b.p_partkey, a.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN a.p_partkey IS NULL THEN 'removed' WHEN a.p_size IS DISTINCT FROM b.p_size OR a.p_retailprice IS DISTINCT FROM b.p_retailprice THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN a ON a.p_partkey = b.p_partkey",
    "dedupe_first": _FIRST.format(keys="user_id, event_type", order="event_id", rows="SELECT user_id, event_type, event_id, value FROM events"),
    "dedupe_last": "SELECT user_id, event_type, min(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "dedupe_prefer": _FIRST.format(keys="user_id", order="(event_type = 'view'), event_id", rows="SELECT user_id, event_type, event_id FROM events"),
    "dedupe_composite_nulls": _FIRST.format(keys="user_id, event_type, day", order="event_id", rows="SELECT CASE WHEN user_id % 4 > 0 THEN user_id END AS user_id, event_type, ts::DATE AS day, event_id FROM events"),
    "dedupe_texts": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE trim(text) <> '') WHERE k = 1",
    "repeated_ids": "SELECT user_id, event_type, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "union_sources": "SELECT 0::INT AS source_ord, count(*) AS n, count(o_orderstatus) AS with_status, 0::BIGINT AS with_priority FROM orders UNION ALL SELECT 1, count(*), 0, count(l_returnflag) FROM lineitem",
    "type_histogram": "SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1",
    "spot_top10": ORDERS + " SELECT o_custkey, position::INT AS position, o_orderkey, date_from FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY date_from, o_orderkey) AS position FROM ev) WHERE position <= 10",
    "page_offset": "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 20",
    "search_suggestions": "SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '1') ORDER BY c_custkey LIMIT 5",
    "owners_not_allowed": "SELECT l_partkey, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1 AND bool_or(l_suppkey % 2 = 1)",
    "search_spots": "SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '00001')",
    "name_order_ja": "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey",
    "carry_forward": "WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value END AS v, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM events) SELECT user_id, event_id, segment::BIGINT AS segment, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id, segment ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS day_value_filled FROM s",
    "phase_segments": "WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS segment FROM c) SELECT user_id, segment, event_type, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY 1, 2, 3",
    "length_budget": "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, (sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS used FROM conversations) WHERE used <= 1500",
    "segment_ends": "SELECT event_id, floor(epoch(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-02-01')))::BIGINT AS end_s FROM events",
    "crawl_reach": "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 + 1 AS dst FROM lineitem), r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT node, min(depth)::INT AS depth FROM r WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = 1) GROUP BY node",
    "next_link_chain": "WITH RECURSIVE l AS (SELECT o_orderkey AS src, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey), first(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS dst FROM orders), c AS (SELECT o_orderkey AS start, 1 AS depth, o_orderkey AS node, [o_orderkey] AS seen FROM orders UNION ALL SELECT c.start, c.depth + 1, l.dst, list_append(c.seen, l.dst) FROM c JOIN l ON l.src = c.node WHERE c.depth < 7 AND NOT list_contains(c.seen, l.dst)) SELECT start, depth::INT AS depth, node FROM c",
    "filter_summary_by_status": ORDERS + " SELECT o_orderstatus, count(*) AS before, count(*) FILTER (WHERE date_to >= DATE '1997-06-15') AS after, count(*) FILTER (WHERE NOT date_to >= DATE '1997-06-15') AS removed FROM ev GROUP BY 1",
    "exclusion_counters": "SELECT l_returnflag, count(*) AS seen, count(*) FILTER (WHERE l_discount = 0) AS no_discount, count(*) FILTER (WHERE l_quantity < 5) AS small, max(l_shipdate)::DATE AS latest FROM lineitem GROUP BY 1",
    "date_bag": "SELECT l_orderkey, CASE WHEN max(l_linenumber) < 7 THEN min(l_shipdate)::DATE END AS date_from, CASE WHEN max(l_linenumber) < 7 THEN max(l_shipdate)::DATE END AS date_to FROM lineitem GROUP BY 1",
}
