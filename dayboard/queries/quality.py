"""Quality gates, validation, sitemaps, scans of text."""

from __future__ import annotations

from ..functions import text, urls
from ..operators import render, stats
from ..sources import readers, writers
from .base import AS_OF, F, table


def quality_gate(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return stats.quality_gate(d, ["lang"], F.when(F.col("n_chars") > 100, F.col("text")), F.col("quality").isNotNull())


def validation_violations(spark, sf):
    d = table(spark, sf, "documents")
    title = F.when(F.col("doc_id") % 9 == 0, "x").when(F.col("doc_id") % 9 == 1, F.lit(None)).otherwise(F.col("source"))
    day = F.when(F.col("doc_id") % 7 == 0, "2024-1-5").when(F.col("doc_id") % 7 == 1, F.lit(None)).otherwise("2024-01-05")
    return stats.violations(d.select("doc_id", title.alias("title"), day.alias("date_from")), "doc_id")


def seo_problems(spark, sf):
    p = table(spark, sf, "pages")
    head = F.when(F.col("page_id") % 2 == 0, '<meta name="description" content="x"><link rel="canonical" href="y">').otherwise('<link rel="canonical" href="y"><meta property="og:url" content="z">')
    return stats.seo_problems(p.select("page_id", F.concat(head, F.col("html")).alias("html")), "page_id", "html")


def conflict_lines(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("a\n"), F.when(F.col("p_partkey") % 5 == 0, "<<<<<<< HEAD\nb\n=======\n").otherwise("<<<<<<<x\n"), F.lit("  >>>>>>> c\n"), F.when(F.col("p_partkey") % 3 == 0, ">>>>>>>").otherwise("z")).alias("text"))
    return stats.conflict_lines(p, "p_partkey", "text")


def sitemap_entries(spark, sf):
    p = table(spark, sf, "pages").select("page_id", urls.normalise(F.col("url")).alias("loc"), F.when(F.col("page_id") % 2 == 0, "date").otherwise("spot").alias("category"))
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("page_id")).agg(F.max(F.to_date("ts")).alias("lastmod"))
    rows = p.join(e, "page_id", "left").withColumn("lastmod", F.coalesce("lastmod", F.lit("2024-01-01").cast("date")))
    out = render.sitemap_entries(rows, "loc", "lastmod", "category")
    return out.select("category", "loc", render.sitemap_xml(F.col("loc"), F.col("lastmod").cast("string")).alias("xml"))


def sitemap_files(spark, sf):
    """Url sets of at most 400 parts each, of three categories, and their index; of repeated addresses the last stays."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(F.concat(F.lit("https://v.jp/?a&p="), F.lpad((k % 1500).cast("string"), 5, "0")).alias("loc"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("category"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 7).cast("int")).alias("lastmod"), k.alias("ord"))
    return render.sitemap_files(render.sitemap_entries(p, "loc", "lastmod", "category", "ord"), "https://v.jp", AS_OF, 400)


def venue_outputs(spark, sf):
    """Documents of customers with their orders as events."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    e = table(spark, sf, "orders").select(c.cast("string").alias("venue_id"), F.when(c % 2 == 0, F.concat(F.lit('館"'), c.cast("string"))).alias("venue_name"), k.alias("ord"), F.concat(F.lit("P\n"), k.cast("string")).alias("title"), F.when(k % 2 == 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("tags"), F.lit(None).cast("string").alias("price"))
    return writers.venue_outputs(e, AS_OF, "ord")


def changed_pages(spark, sf):
    p = table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"), "page_id")
    old = p.select("path", F.sha2(F.when(F.col("page_id") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("digest"))
    return writers.changed_pages(p, old).select("path", "digest")


def marker_splice(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit("<!--A-->old\ntext<!--B-->tail")).alias("t"))
    return p.select("p_partkey", writers.splice("t", "<!--A-->", "<!--B-->", "new $1").alias("t"))


def csv_cells(spark, sf):
    line = F.concat(F.lit('"'), F.col("p_name"), F.lit(', x", '), F.col("p_brand"), F.lit(","), F.col("p_size").cast("string"))
    c = readers.csv_cells(line)
    return table(spark, sf, "part").select("p_partkey", *[F.get(c, i).alias(f"c{i}") for i in range(3)])


def table_cells(spark, sf):
    html = F.concat(F.lit("<table><tr><th>Name</th><td class='x'>"), F.col("p_name"), F.lit("</td></tr><tr><td>Brand</td><td><b>"), F.col("p_brand"), F.lit("</b></td></tr></table>"))
    rows = readers.table_rows(html)
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(rows, lambda r: F.array_join(r, "=")), ";").alias("cells"))


def label_values(spark, sf):
    html = F.concat(F.lit("<dl><dt>名前</dt><dd>"), F.col("p_name"), F.lit("</dd><dt>型</dt><dd>"), F.col("p_type"), F.lit("</dd><dt>名前</dt><dd>last</dd></dl>"))
    m = text.label_map(html)
    lines = F.array(F.lit("会場:Hall"), F.lit("料金"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", m["名前"].alias("name"), m["型"].alias("type"), text.labeled_value(lines, ["料金", "価格"]).alias("price"), text.labeled_value(lines, ["会場"]).alias("place"), text.labeled_value(lines, ["電話"]).alias("phone"))


def price_and_contact(spark, sf):
    t = F.when(F.col("p_partkey") % 3 == 0, "入場無料").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("一般 "), F.col("p_size").cast("string"), F.lit("円"))).otherwise("詳細はこちら")
    lines = F.array(F.lit("場所"), F.concat(F.lit("TEL 088-123-"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")))
    return table(spark, sf, "part").select("p_partkey", text.price_of(t).alias("price"), text.normalize_price(t).alias("shown"), text.contact_line(lines).alias("contact"))


def seo_attributes(spark, sf):
    html = F.concat(F.lit('<html><link href="https://e.org/'), F.col("page_id").cast("string"), F.lit('" rel="canonical">'), F.col("html"))
    return table(spark, sf, "pages").select("page_id", text.attribute(html, r'(?i)<link\s[^>]*rel="canonical"[^>]*>', "href").alias("canonical"), text.first_image(html).alias("image"))


def report_lines(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", render.report_line([(F.col("n_name"), 12), (F.col("n_regionkey").cast("string"), 4)]).alias("line"))


QUERIES = {f.__name__: f for f in (quality_gate, validation_violations, seo_problems, conflict_lines, sitemap_entries, sitemap_files, venue_outputs, changed_pages, marker_splice, csv_cells, table_cells, label_values, price_and_contact, seo_attributes, report_lines)}

_NORMAL = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')"
_MARK = {"title": r"<title>[^<]+</title>", "description": r"<meta\s+name=[\"'']description[\"''][^>]*>", "canonical": r"<link\s+rel=[\"'']canonical[\"''][^>]*>", "og:url": r"<meta\s+property=[\"'']og:url[\"''][^>]*>", "og:image": r"<meta\s+property=[\"'']og:image[\"''][^>]*>", "og:image:alt": r"<meta\s+property=[\"'']og:image:alt[\"''][^>]*>", "twitter:title": r"<meta\s+name=[\"'']twitter:title[\"''][^>]*>", "twitter:description": r"<meta\s+name=[\"'']twitter:description[\"''][^>]*>"}
SQL = {
    "quality_gate": r"WITH d AS (SELECT lang, count(*) AS total, count(*) FILTER (WHERE NOT (n_chars > 100) OR text IS NULL OR trim(regexp_replace(text, '\s+', ' ', 'g')) = '') AS missing_title, count(*) FILTER (WHERE quality IS NULL) AS missing_date FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) SELECT lang, total, missing_title, missing_date, missing_title / total AS title_rate, missing_date / total AS date_rate, CASE WHEN greatest(missing_title, missing_date) / total > 0.03 THEN 'fail' WHEN greatest(missing_title, missing_date) / total > 0.01 THEN 'warn' ELSE 'ok' END AS status FROM d",
    "validation_violations": "SELECT doc_id, CASE WHEN doc_id % 9 IN (0, 1) THEN 'title' ELSE 'date_from' END AS violation FROM documents WHERE doc_id % 9 IN (0, 1) OR doc_id % 7 IN (0, 1)",
    "seo_problems": "WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<meta name=\"description\" content=\"x\"><link rel=\"canonical\" href=\"y\">' ELSE '<link rel=\"canonical\" href=\"y\"><meta property=\"og:url\" content=\"z\">' END || html AS html FROM pages) " + " UNION ALL ".join(f"SELECT page_id, '{k}' AS problem FROM p WHERE NOT regexp_matches(html, '(?i){v}')" for k, v in _MARK.items()) + " UNION ALL SELECT page_id, 'canonical <> og:url' FROM p WHERE page_id % 2 <> 0",
    "conflict_lines": r"""WITH t AS (SELECT p_partkey, string_split(concat('a', chr(10), CASE WHEN p_partkey % 5 = 0 THEN concat('<<<<<<< HEAD', chr(10), 'b', chr(10), '=======', chr(10)) ELSE concat('<<<<<<<x', chr(10)) END, '  >>>>>>> c', chr(10), CASE WHEN p_partkey % 3 = 0 THEN '>>>>>>>' ELSE 'z' END), chr(10)) AS l FROM part), u AS (SELECT p_partkey, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM t) SELECT p_partkey, n::INT AS line_no, line FROM u WHERE regexp_matches(line, '^(<{7}|={7}|>{7})(\s|$)')""",
    "sitemap_entries": f"WITH e AS (SELECT user_id AS page_id, max(ts::DATE) AS lastmod FROM events GROUP BY 1), r AS (SELECT {_NORMAL} AS loc, CASE WHEN page_id % 2 = 0 THEN 'date' ELSE 'spot' END AS category, max(coalesce(lastmod, DATE '2024-01-01')) AS lastmod FROM pages LEFT JOIN e USING (page_id) GROUP BY 1, 2) SELECT category, loc, concat('<url><loc>', loc, '</loc><lastmod>', lastmod, '</lastmod></url>') AS xml FROM r",
    "changed_pages": "SELECT url AS path, sha256(html) AS digest FROM pages WHERE page_id % 3 = 0",
    "marker_splice": "SELECT p_partkey, concat(p_name, '<!--A-->new $1<!--B-->tail') AS t FROM part",
    "sitemap_files": """WITH e AS (SELECT concat('https://v.jp/?a&amp;p=', lpad((p_partkey % 1500)::VARCHAR, 5, '0')) AS loc, concat('c', p_partkey % 3) AS category, arg_max(DATE '2024-01-01' + (p_partkey % 7)::INT, p_partkey) AS lastmod FROM part GROUP BY 1, 2),
      r AS (SELECT *, (row_number() OVER (PARTITION BY category ORDER BY loc) - 1) // 400 AS part FROM e),
      f AS (SELECT concat('sitemap-', category, CASE WHEN part > 0 THEN concat('-', part + 1) END, '.xml') AS file, count(*)::INT AS n_entries, string_agg(concat('  <url>\n    <loc>', loc, '</loc>\n    <lastmod>', lastmod, '</lastmod>\n  </url>\n'), '' ORDER BY loc) AS body FROM r GROUP BY category, part),
      d AS (SELECT file, n_entries, 'urlset' AS tag, body FROM f UNION ALL SELECT 'sitemap.xml', count(*)::INT, 'sitemapindex', string_agg(concat('  <sitemap>\n    <loc>https://v.jp/', file, '</loc>\n    <lastmod>1998-06-15</lastmod>\n  </sitemap>\n'), '' ORDER BY file) FROM f)
      SELECT file, n_entries, concat('<?xml version="1.0" encoding="UTF-8"?>\n<', tag, ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n', body, '</', tag, '>\n') AS xml FROM d""",
    "venue_outputs": r"""SELECT o_custkey::VARCHAR AS venue_id, concat(E'{\n  "venue_id": "', o_custkey, E'",\n', CASE WHEN o_custkey % 2 = 0 THEN concat('  "venue_name": "館\"', o_custkey, E'",\n') END, E'  "last_success_at": "1998-06-15",\n  "events": [\n',
        string_agg(concat(E'    {\n      "title": "P\\n', o_orderkey, E'",\n      "tags": ', CASE WHEN o_orderkey % 2 = 0 THEN concat(E'[\n        "', o_orderpriority, E'"\n      ]') ELSE '[]' END, E',\n      "price": null\n    }'), E',\n' ORDER BY o_orderkey), E'\n  ]\n}') AS json FROM orders GROUP BY o_custkey""",
    "csv_cells": "SELECT p_partkey, concat(p_name, ', x') AS c0, p_brand AS c1, p_size::VARCHAR AS c2 FROM part",
    "table_cells": "SELECT p_partkey, concat('Name=', p_name, ';Brand=', p_brand) AS cells FROM part",
    "label_values": "SELECT p_partkey, 'last' AS name, p_type AS type, p_brand AS price, 'Hall' AS place, '' AS phone FROM part",
    "price_and_contact": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '無料' WHEN 1 THEN concat(p_size, '円') END AS price, CASE p_partkey % 3 WHEN 0 THEN '入場無料' WHEN 1 THEN concat('一般 ', p_size, '円') END AS shown, concat('TEL 088-123-', lpad((p_partkey % 10000)::VARCHAR, 4, '0')) AS contact FROM part",
    "seo_attributes": """SELECT page_id, concat('https://e.org/', page_id) AS canonical, nullif(regexp_extract(html, '(?is)<img[^>]*src=["'']([^"'']+)["'']', 1), '') AS image FROM pages""",
    "report_lines": "SELECT n_nationkey, concat(CASE WHEN length(n_name) < 12 THEN rpad(n_name, 12, ' ') ELSE n_name END, '  ', rpad(n_regionkey::VARCHAR, 4, ' ')) AS line FROM nation",
}
