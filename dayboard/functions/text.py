"""Text and HTML columns.  Everything is a built-in expression, so it stays inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import filled, once

# The white space that pages contain, beyond ASCII; leading decoration of headings; label words that
# stand where a price or a contact should; generic page titles; words that say nothing in titles.
SPACE = r"[\s\x{3000}\x{00A0}\x{FEFF}\p{Zs}\x{2028}\x{2029}]"
DECORATION = r"^[\s\-–—―~〜～:：・|｜]+"
PRICE_LABELS = ["お申し込み方法", "申込方法", "リンク", "詳細はこちら", "詳しくはこちら", "お申し込みはこちら", "申込はこちら", "こちら"]
CONTACT_LABELS = ["リンク", "こちら", "詳細はこちら", "詳しくはこちら", "お問い合わせはこちら"]
GENERIC_TITLES = ["イベント情報", "イベント一覧", "イベント情報一覧", "Event", "イベント"]
STOP_WORDS = ["令和", "年度", "第", "開催", "情報", "案内", "高松", "松山", "愛媛", "徳島", "香川", "四国"]
TITLE_PUNCTUATION = r"""[！!？?。、,，・:：;；/\\()（）\[\]【】「」『』<>＜＞"'`~〜★☆♪]"""
ENTITIES = [("&quot;", '"'), ("&#039;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")]
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]


def _replace(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def decode_entities(text: Column) -> Column:
    """Six entities, one after the other, so that ``&amp;lt;`` ends as ``<``; all others stay."""
    return _replace(text, ENTITIES)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", " ")


def strip_tags_compact(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def strip_tags_with_breaks(html: Column) -> Column:
    return strip_tags(F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"(?i)</(p|li|div|dt|dd)>", "\n"))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize_space(text: Column) -> Column:
    """Every run of white space becomes one space; none is left at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def normalize_decoded(text: Column) -> Column:
    return F.coalesce(normalize_space(decode_entities(text)), F.lit(""))


def remove_noise(html: Column) -> Column:
    """Without scripts, styles and comments."""
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->"):
        html = F.regexp_replace(html, pattern, " ")
    return html


def plain_text(html: Column) -> Column:
    return normalize_space(decode_entities(strip_tags(remove_noise(html))))


def text_lines(html: Column) -> Column:
    """Array of trimmed lines that are not empty."""
    lines = F.transform(F.split(decode_entities(strip_tags_with_breaks(html)), r"\r?\n"), normalize_space)
    return F.filter(lines, lambda x: x != "")


def half_width(text: Column) -> Column:
    """Full-width digits and colon, and every kind of dash, the long-vowel mark among them."""
    return F.translate(text, "０１２３４５６７８９：‐‑‒–—―ー", "0123456789:-------")


def heading_title(text: Column) -> Column:
    return normalize_space(F.regexp_replace(F.coalesce(text, F.lit("")), DECORATION, ""))


def labeled_value(lines: Column, labels: list[str]) -> Column:
    """Value of the first line that has a label, wherever in it, trying labels in their order: what follows the label,
    or the next line if the label stands alone."""
    pairs = F.arrays_zip(lines.alias("line"), F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit(""))).alias("next"))

    def value(p: Column) -> Column:
        found = []
        for label in labels:
            same = F.regexp_extract(p["line"], rf"{re.escape(label)}\s*[:：]?\s*(.+)", 1)
            found += [filled(trim_space(same)), F.when(trim_space(p["line"]) == label, filled(trim_space(p["next"])))]
        return F.coalesce(*found)

    return F.coalesce(F.get(F.filter(F.transform(pairs, value), lambda x: x.isNotNull()), 0), F.lit(""))


def first_capture(html: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, null if there is none."""
    return filled(F.regexp_extract(html, pattern, group))


def tag_text(html: Column, tag: str) -> Column:
    return filled(plain_text(first_capture(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>")))


def event_title(html: Column) -> Column:
    """Title of a detail page: a titled h1, else the first h1 of the article, else the first h2; generic ones are ''."""
    found = [
        first_capture(html, r"""(?is)<h1[^>]*class=["'][^"']*(?:entry-title|post-title)[^"']*["'][^>]*>(.*?)</h1>"""),
        first_capture(first_capture(html, r"(?is)<article\b[^>]*>(.*?)</article>"), r"(?is)<h1[^>]*>(.*?)</h1>"),
        first_capture(html, r"(?is)<h2[^>]*>(.*?)</h2>"),
    ]
    ok = [once(plain_text(x), lambda t: F.when(~contains_any(t, GENERIC_TITLES) & (t != ""), t)) for x in found]
    return F.coalesce(*ok, F.lit(""))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _unless_label(text: Column, words: list[str]) -> Column:
    return once(normalize_space(text), lambda t: F.when((t != "") & ~contains_any(t, words), t))


def normalize_price(text: Column) -> Column:
    return _unless_label(text, PRICE_LABELS)


def normalize_contact(text: Column) -> Column:
    return _unless_label(text, CONTACT_LABELS)


def truncate(text: Column, n: int, suffix: str = "…") -> Column:
    return once(text, lambda t: F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit(suffix))).otherwise(t))


def line_budget(lines: Column, most: int, suffix: str = "…", *, cut_first: bool = True, within: bool = False) -> Column:
    """Lines joined while they fit into so many signs, the last kept one marked if more were left out.

    A first line that is too long alone is cut, or gives nothing without ``cut_first``.  With ``within``, the mark takes
    the place of the last sign where it would not fit.
    """

    def step(done: Column, line: Column) -> Column:
        kept = done["kept"]
        more = F.when(kept == "", line).otherwise(F.concat(kept, F.lit("\n"), line))
        marked = F.concat(F.when(F.length(kept) + len(suffix) > most, F.left(kept, F.length(kept) - len(suffix))).otherwise(kept) if within else kept, F.lit(suffix))
        first = F.concat(F.left(line, F.lit(most - len(suffix))), F.lit(suffix)) if cut_first else F.lit("")
        full = F.struct(F.when(kept == "", first).otherwise(marked).alias("kept"), F.lit(True).alias("full"))
        return F.when(done["full"], done).when(F.length(more) <= most, F.struct(more.alias("kept"), F.lit(False).alias("full"))).otherwise(full)

    return F.aggregate(lines, F.struct(F.lit("").alias("kept"), F.lit(False).alias("full")), step, lambda done: done["kept"])


def lines_at(html: Column, ends: str = "") -> Column:
    """Array of the lines between line breaks and ends of the named elements, without tags, trimmed, none empty."""
    broken = F.regexp_replace(decode_entities(html), r"(?i)<br\s*/?>" + (rf"|</(?:{ends})>" if ends else ""), "\n")
    return F.filter(F.transform(F.split(strip_tags_compact(broken), r"\r?\n"), normalize_space), lambda x: x != "")


def alternate(text: Column, pattern: str) -> Column:
    """Array of what stands between the matches of a pattern and the matches themselves, by turns: text, match, text, ..,
    text.  Joined it is the text again; the pattern must not match the empty text."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_compact(F.flatten(F.zip_with(between, found, lambda b, m: F.array(b, m))))


def pieces(html: Column, head: str) -> Column:
    """Array of the parts of a page that begin with a match of ``head``, each up to the next one."""
    return F.filter(F.split(html, rf"(?is)(?={head})"), lambda x: x.rlike(rf"(?is)^{head}"))


def tag_search_text(text: Column) -> Column:
    """What tag rules are looked up in: no numeric entities, no white space, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"&#\d+;", ""), f"{SPACE}+", ""))


def title_tokens(title: Column) -> Column:
    """Tokens of two signs at least that are neither numbers nor stop words."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"&#\d+;", ""), TITLE_PUNCTUATION, " "))
    tokens = F.split(clean, f"{SPACE}+")
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9０-９-]+$") & ~t.isin(STOP_WORDS))


def escape_html(text: Column) -> Column:
    return _replace(text, [*ESCAPES, ("'", "&#39;")])


def escape_xml(text: Column) -> Column:
    return _replace(text, [*ESCAPES, ("'", "&apos;")])


def escape_json_ld(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("\\u003c"))


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n{3,}", "\n\n")


def plain_newlines(text: Column) -> Column:
    """Line feeds only, and tabs, ideographic and no-break spaces as spaces."""
    out = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\t\x{3000}]+", " ")
    return F.translate(out, "\u00a0", " ")


def remove_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{200B}-\x{200D}\x{FEFF}]", "")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""), F.lit(1))


def first_image(html: Column) -> Column:
    return F.coalesce(first_capture(html, r"""(?is)<article.*?<img[^>]*src=["']([^"']+)["']"""), first_capture(html, r"""(?is)<img[^>]*src=["']([^"']+)["']"""))


def label_map(html: Column) -> Column:
    """Map of dt to dd texts; a repeated label keeps its last value."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>.*?</dd>"), F.lit(1)).alias("k"), F.regexp_extract_all(html, F.lit(r"(?is)<dt[^>]*>.*?</dt>\s*<dd[^>]*>(.*?)</dd>"), F.lit(1)).alias("v"))
    clean = F.transform(pairs, lambda p: F.struct(plain_text(p["k"]).alias("k"), plain_text(p["v"]).alias("v")))
    none = F.array().cast("array<struct<k:string,v:string>>")
    last = F.aggregate(clean, none, lambda done, p: F.concat(F.filter(done, lambda q: q.k != p.k), F.array(p)))
    return F.map_from_entries(last)


def attribute(html: Column, tag_pattern: str, name: str) -> Column:
    """Value of an attribute of the first tag that matches."""
    return first_capture(F.regexp_extract(html, tag_pattern, 0), rf"""(?i)\b{name}=["']([^"']*)["']""")


def is_blank(text: Column) -> Column:
    return text.isNull() | (trim_space(text) == "")


def price_of(text: Column) -> Column:
    """``無料``, or the first amount in yen, or null."""
    return F.when(text.contains("無料"), F.lit("無料")).otherwise(first_capture(text, r"([0-9,，]+\s*円)"))


def contact_line(lines: Column) -> Column:
    return F.get(F.filter(lines, lambda x: x.rlike(r"(?i)TEL|電話") & x.rlike(r"\d{2,4}-\d{2,4}-\d{3,4}")), 0)
