"""Text, HTML, URL and tag columns."""

from __future__ import annotations

from ..functions import tags, text, urls, values
from ..operators import dedupe, stats
from .base import F, order_events, table


def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.tag_text(F.col("html"), "title").alias("title"))


def html_h1(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.tag_text(F.col("html"), "h1").alias("h1"))


def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.plain_text(F.col("html")).alias("body"))


def html_lines(spark, sf):
    lines = text.text_lines(text.remove_noise(F.col("html")))
    return table(spark, sf, "pages").select("page_id", F.size(lines).cast("long").alias("n_lines"), F.get(lines, 1).alias("second"))


def html_noise_removed(spark, sf):
    clean = text.remove_noise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(clean).cast("long").alias("n"), F.md5(clean).alias("digest"))


def html_links(spark, sf):
    links = text.links(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.array_join(links, " ").alias("links"))


def union_distinct_links(spark, sf):
    p = table(spark, sf, "pages")
    a = p.where("page_id % 2 = 0").select(F.explode(text.links(F.col("html"))).alias("link"))
    b = p.where("page_id % 2 = 1").select(F.explode(text.links(F.col("html"))).alias("link"))
    return dedupe.union_sources(a, b).groupBy("link").agg(F.count_distinct("source_ord").alias("n_sources"))


def html_event_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.event_title(F.col("html")).alias("title"))


def entity_decoding(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.decode_entities(F.col("html"))).alias("digest"))


def url_category(spark, sf):
    p = F.regexp_replace(urls.path(F.col("url")), "^/", "")
    rest = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("date/"), p)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("spot/"), p)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("facility-name/"), p)).otherwise(p)
    return table(spark, sf, "pages").select("page_id", urls.category(rest).alias("category"))


def url_normalise(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalise(F.col("url")).alias("normal"))


def url_predicate(spark, sf):
    u = F.concat(F.lit("https://example.org/event/"), F.when(F.col("page_id") % 3 == 0, "page/2/").when(F.col("page_id") % 3 == 1, F.concat(F.col("page_id").cast("string"), F.lit("/"))).otherwise(""))
    return table(spark, sf, "pages").select("page_id", urls.is_event_detail(u).alias("detail"), urls.is_event_detail(F.col("url")).alias("plain"))


def public_urls(spark, sf):
    f = F.concat(F.lit("/spot/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "/index.html").otherwise(".html"))
    return table(spark, sf, "pages").select("page_id", urls.public_url(f, "https://example.org/").alias("loc"))


def url_encoding(spark, sf):
    return table(spark, sf, "part").select("p_partkey", urls.encode_component(F.col("p_name")).alias("encoded"))


def text_normalise(spark, sf):
    t = F.concat(F.lit("　 "), F.col("text"), F.lit(" \n"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_space(t)).alias("digest"))


def fullwidth_digits(spark, sf):
    t = F.concat(F.translate(F.col("o_orderkey").cast("string"), "0123456789", "０１２３４５６７８９"), F.lit("：ー"))
    return order_events(spark, sf).select("o_orderkey", text.half_width(t).alias("half"))


def truncate_body(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text"), 300).alias("short"))


def escape_texts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(text.escape_html(F.col("text"))).alias("html"), F.md5(text.escape_xml(F.col("text"))).alias("xml"), F.md5(text.escape_json_ld(F.col("text"))).alias("json_ld"))


def newline_unification(spark, sf):
    t = F.concat(F.col("text"), F.lit("\r\n\r\n\n\nend"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.unify_newlines(t)).alias("digest"))


def token_top_by_type(spark, sf):
    return stats.top_tokens(table(spark, sf, "part"), "p_brand", text.title_tokens(F.col("p_name")), "p_partkey").select("p_brand", "token", "n", "place")


def _title(n="o_orderkey"):
    words = ["春の美術展覧会", "サッカー大会", "Piano Concert", "親子工作 教室", "市民講座", "映画上映会", "夜間特別公開", "就職フェア", "会議", "ふれあい広場"]
    return F.get(F.array(*map(F.lit, words)), (F.col(n) % len(words)).cast("int"))


def classify_type(spark, sf):
    o = order_events(spark, sf)
    return o.groupBy(tags.event_type(_title(), F.lit("")).alias("type")).agg(F.count("*").alias("n"))


def classify_genres(spark, sf):
    rules = {"blue": ["blue"], "red": ["red", "rose"], "green": ["green", "lime"], "steel": ["steel"], "big": ["large", "big"]}
    got = tags.genres(F.concat_ws(" ", "p_name", "p_type"), rules)
    return table(spark, sf, "part").select("p_partkey", F.array_join(got, ",").alias("genres"))


def classify_flags(spark, sf):
    e = table(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    price = F.when(F.col("event_id") % 5 == 0, "無料").when(F.col("event_id") % 5 == 1, "500円")
    got = tags.flags(F.col("event_type"), price, F.date_format("ts", "HH:mm"), F.lit(None).cast("string"), day, F.lit(None).cast("string"))
    return e.select("event_id", F.array_join(got, ",").alias("flags"))


def error_kinds(spark, sf):
    msg = F.get(F.array(*map(F.lit, ["[VALIDATION ERROR] x", "HTTP 503", "パースできない", "取得結果が空", "request TIMEOUT", "other"])), (F.col("event_id") % 6).cast("int"))
    kind = values.error_type(msg)
    return table(spark, sf, "events").groupBy(F.coalesce(kind, F.lit("UNKNOWN")).alias("kind")).agg(F.count("*").alias("n"), F.bool_or(values.is_retryable(kind)).alias("retry"))


def json_props(spark, sf):
    k = values.parse_json(F.col("props"), "k int", F.struct(F.lit(-1).alias("k")))
    return table(spark, sf, "events").select("event_id", k["k"].alias("k"))


def jsonld_event(spark, sf):
    from ..operators.render import json_ld_event

    o = order_events(spark, sf)
    status = values.schema_org_status(F.when(F.col("o_orderstatus") == "O", "postponed").otherwise("scheduled"))
    body = json_ld_event(F.concat(F.lit("<order> "), F.col("o_orderkey").cast("string")), F.col("date_from").cast("string"), F.col("date_to").cast("string"), status, F.when(F.col("o_orderkey") % 2 == 0, F.lit("Hall")))
    return o.select("o_orderkey", body.alias("json_ld"))


def day_cards(spark, sf):
    from ..operators.render import event_card

    o = order_events(spark, sf)
    card = event_card(F.concat(F.lit("A & B "), F.col("o_orderkey").cast("string")), F.col("date_from").cast("string"), F.concat(F.lit("/e/"), F.col("o_orderkey").cast("string")))
    cards = o.groupBy("date_from").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", card.alias("card")))).alias("cards"))
    return cards.select("date_from", F.array_join("cards.card", "").alias("html"))


def clamp_and_percent(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", values.clamp(F.col("l_quantity").cast("int"), 1, 8).alias("workers"), values.percent(F.col("l_discount")).alias("rate"), values.rate_status(F.col("l_discount")).alias("status"))


QUERIES = {f.__name__: f for f in (html_title, html_h1, html_text, html_lines, html_noise_removed, html_links, union_distinct_links, html_event_title, entity_decoding, url_category, url_normalise, url_predicate, public_urls, url_encoding, text_normalise, fullwidth_digits, truncate_body, escape_texts, newline_unification, token_top_by_type, classify_type, classify_genres, classify_flags, error_kinds, json_props, jsonld_event, day_cards, clamp_and_percent)}

_C = r"[\s\x{3000}\x{00A0}\x{FEFF}\p{Zs}\x{2028}\x{2029}]"


def _norm(x):
    return rf"regexp_replace(regexp_replace({x}, '{_C}+', ' ', 'g'), '^ | $', '', 'g')"


def _decode(x):
    for a, b in (("&quot;", '"'), ("&#039;", "''"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _clean(x):
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"


def _plain(x):
    return _norm(_decode(f"regexp_replace({_clean(x)}, '<[^>]*>', ' ', 'g')"))


def _esc(x, quote):
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '{quote}')"


_LINKS = r"""regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"'']+)["'']', 1)"""
_LINES = rf"list_filter(list_transform(regexp_split_to_array({_decode(r"regexp_replace(regexp_replace(regexp_replace(" + _clean("html") + r", '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|li|div|dt|dd)>', chr(10), 'g'), '<[^>]*>', ' ', 'g')")}, '\r?\n'), lambda x: {_norm('x')}), lambda x: x <> '')"
_PATH = r"regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/', '')"
SQL = {
    "html_title": rf"SELECT page_id, nullif({_plain(r"regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title>', 1)")}, '') AS title FROM pages",
    "html_h1": rf"SELECT page_id, nullif({_plain(r"regexp_extract(html, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1>', 1)")}, '') AS h1 FROM pages",
    "html_text": f"SELECT page_id, {_plain('html')} AS body FROM pages",
    "html_lines": f"SELECT page_id, len(l)::BIGINT AS n_lines, l[2] AS second FROM (SELECT page_id, {_LINES} AS l FROM pages)",
    "html_noise_removed": f"SELECT page_id, length(c)::BIGINT AS n, md5(c) AS digest FROM (SELECT page_id, {_clean('html')} AS c FROM pages)",
    "html_links": f"SELECT page_id, len(l)::BIGINT AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, {_LINKS} AS l FROM pages)",
    "union_distinct_links": f"SELECT link, count(DISTINCT s) AS n_sources FROM (SELECT page_id % 2 AS s, unnest({_LINKS}) AS link FROM pages) GROUP BY 1",
    "html_event_title": rf"""WITH t AS (SELECT page_id, {_plain(r"regexp_extract(html, '(?is)<h1[^>]*class=[""''][^""'']*(?:entry-title|post-title)[^""'']*[""''][^>]*>(.*?)</h1>', 1)".replace('""', '"'))} AS a, {_plain("regexp_extract(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS b, {_plain("regexp_extract(html, '(?is)<h2[^>]*>(.*?)</h2>', 1)")} AS c FROM pages) SELECT page_id, coalesce({', '.join(f"CASE WHEN {x} <> '' AND NOT (contains({x}, 'Event') OR contains({x}, 'イベント')) THEN {x} END" for x in 'abc')}, '') AS title FROM t""",
    "entity_decoding": f"SELECT page_id, md5({_decode('html')}) AS digest FROM pages",
    "url_category": "SELECT page_id, ['date', 'spot', 'facility', 'other'][(page_id % 4) + 1] AS category FROM pages",
    "url_normalise": r"SELECT page_id, regexp_replace(concat(lower(regexp_extract(b, '^([a-z]+://[^/]+)', 1)), substr(b, length(regexp_extract(b, '^([a-z]+://[^/]+)', 1)) + 1)), '/$', '') AS normal FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS b FROM pages)",
    "url_predicate": rf"SELECT page_id, page_id % 3 = 1 AS detail, contains('/' || {_PATH}, '/event/') AND regexp_matches({_PATH}, '/\d+/?$') AS plain FROM pages",
    "public_urls": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('https://example.org/spot/', page_id, '/') ELSE concat('https://example.org/spot/', page_id, '.html') END AS loc FROM pages",
    "url_encoding": "SELECT p_partkey, replace(p_name, ' ', '%20') AS encoded FROM part",
    "text_normalise": rf"SELECT doc_id, md5({_norm("concat(chr(12288), ' ', text, chr(160), chr(10))")}) AS digest FROM documents",
    "fullwidth_digits": "SELECT o_orderkey, concat(o_orderkey, ':-') AS half FROM orders",
    "truncate_body": "SELECT doc_id, CASE WHEN length(text) > 300 THEN concat(left(text, 300), '…') ELSE text END AS short FROM documents",
    "escape_texts": f"SELECT doc_id, md5({_esc('text', '&#39;')}) AS html, md5({_esc('text', '&apos;')}) AS xml, md5(replace(text, '<', '\\u003c')) AS json_ld FROM documents",
    "newline_unification": r"SELECT doc_id, md5(regexp_replace(regexp_replace(concat(text, chr(13), chr(10), chr(13), chr(10), chr(10), chr(10), 'end'), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents",
    "token_top_by_type": r"WITH t AS (SELECT p_brand, p_partkey, unnest(regexp_split_to_array(lower(p_name), '\s+')) AS token, generate_subscripts(regexp_split_to_array(lower(p_name), '\s+'), 1) AS pos FROM part), c AS (SELECT p_brand, token, count(*) AS n, min(struct_pack(i := p_partkey, pos := pos)) AS seen FROM t WHERE length(token) >= 2 AND NOT regexp_matches(token, '^[0-9-]+$') GROUP BY 1, 2 HAVING count(*) >= 3) SELECT p_brand, token, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, seen) AS place FROM c) WHERE place <= 30",
    "classify_type": "SELECT ['exhibition', 'sports', 'performance', 'workshop', 'lecture', 'screening', 'special_open', 'lecture', 'lecture', 'other'][(o_orderkey % 10) + 1] AS type, count(*) AS n FROM orders GROUP BY 1",
    "classify_genres": "SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(t, 'blue') THEN 'blue' END, CASE WHEN contains(t, 'red') OR contains(t, 'rose') THEN 'red' END, CASE WHEN contains(t, 'green') OR contains(t, 'lime') THEN 'green' END, CASE WHEN contains(t, 'steel') THEN 'steel' END, CASE WHEN contains(t, 'large') OR contains(t, 'big') THEN 'big' END], lambda x: x IS NOT NULL)[1:2], ',') AS genres FROM (SELECT p_partkey, lower(replace(concat(p_name, p_type), ' ', '')) AS t FROM part)",
    "classify_flags": "SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN 'free' END, CASE WHEN event_id % 5 = 1 THEN 'paid' END, CASE WHEN hour(ts) >= 18 THEN 'night' END, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' END], lambda x: x IS NOT NULL)[1:2], ',') AS flags FROM events",
    "error_kinds": "SELECT kind, count(*) AS n, kind = 'NETWORK' AS retry FROM (SELECT ['VALIDATION', 'NETWORK', 'PARSE', 'EMPTY_RESULT', 'NETWORK', 'UNKNOWN'][(event_id % 6) + 1] AS kind FROM events) GROUP BY 1",
    "json_props": "SELECT event_id, coalesce((props::JSON->>'k')::INT, -1) AS k FROM events",
    "jsonld_event": r"""SELECT o_orderkey, concat('{"@context":"https://schema.org","@type":"Event","name":"\u003corder> ', o_orderkey, '","startDate":"', o_orderdate::DATE, '","endDate":"', o_orderdate::DATE + (o_orderkey % 30)::INT, '","eventStatus":"https://schema.org/', CASE WHEN o_orderstatus = 'O' THEN 'EventPostponed' ELSE 'EventScheduled' END, '"', CASE WHEN o_orderkey % 2 = 0 THEN ',"location":{"@type":"Place","name":"Hall"}' ELSE '' END, '}') AS json_ld FROM orders""",
    "day_cards": """SELECT o_orderdate::DATE AS date_from, string_agg(concat('<li class="event-card"><a href="/e/', o_orderkey, '"><span class="event-card__title">A &amp; B ', o_orderkey, '</span><span class="event-card__date">', o_orderdate::DATE, '</span></a></li>'), '' ORDER BY o_orderkey) AS html FROM orders GROUP BY 1""",
    "clamp_and_percent": "SELECT l_orderkey, l_linenumber, least(greatest(trunc(l_quantity)::INT, 1), 8) AS workers, printf('%.2f%%', l_discount * 100) AS rate, CASE WHEN l_discount > 0.03 THEN 'fail' WHEN l_discount > 0.01 THEN 'warn' ELSE 'ok' END AS status FROM lineitem",
}
