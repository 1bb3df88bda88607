"""Extraction from the text of landed pages: ranges with implied years, titles, sections, residues, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import clock, make_date, single_date
from .text import alternate, contains_any, normalize_space, plain_newlines, plain_text, tag_text, trim_space, truncate
from .values import once

# Words around titles and organisers.
STATUS_PREFIX = r"^[\[【(（](?:終了|開催中|中止|延期|受付中|満席)[\]】)）]\s*"
RANGE_SIGN = r"[~～〜]"


def implied_end_range(text: Column) -> Column:
    """``struct(date_from, date_to)`` of ``2026年2月1日～3月2日``: without a sign between there is no range, an end
    before the start is in the next year, and days must exist."""
    sides = F.split(text, RANGE_SIGN)
    full = r"(\d{4})\s*[年/.]\s*(\d{1,2})\s*[月/.]\s*(\d{1,2})"
    year, month, day = (F.regexp_extract(F.get(sides, 0), full, i) for i in (1, 2, 3))
    end_year = F.regexp_extract(F.get(sides, 1), full, 1)
    m, d = (F.regexp_extract(F.get(sides, 1), r"(?:\d{4}\s*[年/.]\s*)?(\d{1,2})\s*[月/.]\s*(\d{1,2})", i) for i in (1, 2))
    start = make_date(year, month, day)
    end = make_date(F.when(end_year != "", end_year).otherwise(year), m, d)
    rolled = F.when((end < start) & (end_year == ""), F.add_months(end, 12)).otherwise(end)
    return F.when((F.size(sides) > 1) & start.isNotNull() & rolled.isNotNull(), F.struct(start.alias("date_from"), rolled.alias("date_to")))


def split_range(text: Column) -> Column:
    """Both sides of a range sign as texts; the end falls back to the start."""
    sides = F.transform(F.split(text, RANGE_SIGN), normalize_space)
    return F.struct(F.get(sides, 0).alias("start"), F.coalesce(F.nullif(F.get(sides, 1), F.lit("")), F.get(sides, 0)).alias("end"))


def inverted_to_single(first: Column, last: Column) -> Column:
    return F.when(last < first, first).otherwise(last)


def slash_key(text: Column) -> Column:
    """ISO text of exactly YYYY/MM/DD, null otherwise."""
    return F.when(text.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.replace(text, F.lit("/"), F.lit("-")))


def time_range(text: Column) -> Column:
    """``struct(start, end)`` of ``H:MM～H:MM``; both null if there is none."""
    return F.struct(clock(F.regexp_extract(text, rf"(\d{{1,2}}:\d{{2}})\s*{RANGE_SIGN}", 1)).alias("start"), clock(F.regexp_extract(text, rf"{RANGE_SIGN}\s*(\d{{1,2}}:\d{{2}})", 1)).alias("end"))


def fallback_title(html: Column, labelled: Column) -> Column:
    """A labelled title, else the first h1, h2 or h3, else the start of the text."""
    return F.coalesce(F.nullif(labelled, F.lit("")), *(tag_text(html, t) for t in ("h1", "h2", "h3")), truncate(plain_text(html), 60))


def clean_title(title: Column) -> Column:
    """Without a status prefix, dates and weekdays."""
    out = F.regexp_replace(title, STATUS_PREFIX, "")
    return normalize_space(F.regexp_replace(out, r"(?:\d{4}年)?\d{1,2}月\d{1,2}日(?:[（(][月火水木金土日][)）])?", " "))


def residue(line: Column) -> Column:
    """What is left of a line without dates, brackets and times: the place."""
    out = F.regexp_replace(line, r"[（(][^）)]*[）)]", " ")
    out = F.regexp_replace(out, r"(?:\d{4}年)?\d{1,2}月\d{1,2}日|\d{1,2}:\d{2}", " ")
    return normalize_space(F.regexp_replace(out, r"[~～〜\-]", " "))


def section(text: Column, start: str, ends: list[str]) -> Column:
    """Text after a heading up to the nearest end marker, or to the end; null without the heading."""
    after = F.when(F.instr(text, start) > 0, F.substr(text, F.instr(text, start) + len(start)))
    far = F.length(after) + 1
    stop = F.least(far, *(F.when(F.instr(after, e) > 0, F.instr(after, e)) for e in ends))
    return F.substr(after, F.lit(1), stop - 1)


def context(text: Column, anchor: str, before: int, after: int) -> Column:
    """So many signs before and after the first place of an anchor."""
    at = F.instr(text, anchor)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at + after - start))


def auto_links(text: Column) -> Column:
    """URLs of a text without the punctuation that follows them."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"'）)」]+)"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?。、]+$", ""))


# What begins a link in a text, and signs that do not end one.
LINKED, TRAILING = r"https?://[^\s]+", "[).,、。]+$"


def auto_link_parts(text: Column) -> Column:
    """A text as an array of ``struct(text, url)`` in order: plain pieces, none empty, and links without the punctuation
    that follows them, which is plain again.  Pieces joined are the text; a null or empty one has none."""
    parts = F.transform(alternate(text, LINKED), lambda p, i: F.struct(p.alias("p"), (i % 2 == 1).alias("linked")))
    none = F.lit(None).cast("string")

    def cut(x: Column) -> Column:
        url = F.regexp_replace(x["p"], TRAILING, "")
        plain = lambda t: F.struct(t.alias("text"), none.alias("url"))
        return F.when(x["linked"], F.array(F.struct(url.alias("text"), url.alias("url")), plain(F.substr(x["p"], F.length(url) + 1)))).otherwise(F.array(plain(x["p"])))

    return F.coalesce(F.filter(F.flatten(F.transform(parts, cut)), lambda x: x["text"] != ""), F.array().cast("array<struct<text:string,url:string>>"))


def _named(text: Column, label: str, stops: str, bad: list[str]) -> Column:
    """The value beside or below a label at the start of a line, up to the next label; null if it is a bad one."""

    def proper(v: Column) -> Column:
        ok = v != ""
        for pattern in bad:
            ok = ok & ~v.rlike(pattern)
        return F.when(ok, v)

    def value(t: Column) -> Column:
        clean = lambda x: once(normalize_space(F.get(F.split(x, rf"\s*(?:{stops})\s*[：:]"), 0)), proper)
        beside = F.regexp_extract(t, rf"(?:^|\n)\s*(?:{label})\s*[：:]\s*([^\n]+)", 1)
        below = F.regexp_extract(t, rf"(?:^|\n)\s*(?:{label})\s*\n\s*([^\n]+)", 1)
        return F.coalesce(clean(beside), clean(below))

    return once(plain_newlines(text), value)


# Labels of organisers and performers, labels that end their values, and what is no name.
CONTACT_STOPS = "お問合せ先|お問い合わせ先|問い合わせ先|連絡先"
NO_NAME = [r"(?i)^(https?://|www\.)", r"^\S+@\S+\.\S+$", r"^[\d\-()＋+\s]+$"]


def organizer(text: Column) -> Column:
    """Who organises, from a description: neither an address nor a number."""
    return _named(text, "企画・主催|主催者|主催", f"{CONTACT_STOPS}|出演者|出演|場所|日時", NO_NAME)


def performer(text: Column) -> Column:
    """Who performs, from a description: not a web address."""
    return _named(text, "出演者|出演", f"主催|{CONTACT_STOPS}|場所|日時", NO_NAME[:1])


# The texts that complete a venue's description.
DESCRIPTION_REGION, DESCRIPTION_TEXT, DESCRIPTION_TAIL = "四国", "の施設詳細ページです。開催予定のイベントやアクセス情報を確認できます。", " 公式サイトや開催予定イベント、アクセス情報への導線をこのページでまとめて確認できます。"


def description(text: Column, name: Column, *, prefecture: Column | None = None, municipality: Column | None = None, category: Column | None = None) -> Column:
    """A venue's description: a missing one is made of its area, category and name; one that is short or ends with a
    stop has a sentence after it."""
    none = F.lit(None).cast("string")
    filled = lambda c: F.nullif(none if c is None else c, F.lit(""))
    area = F.coalesce(F.nullif(F.concat_ws(" ", filled(prefecture), filled(municipality)), F.lit("")), F.lit(DESCRIPTION_REGION))
    made = F.concat(area, F.lit("にある"), F.coalesce(F.concat(filled(category), F.lit("の")), F.lit("")), F.coalesce(name, F.lit("")), F.lit(DESCRIPTION_TEXT))
    t = F.coalesce(F.nullif(trim_space(text), F.lit("")), made)
    return F.when(t.rlike("[、。]$") | (F.length(t) < 60), F.concat(t, F.lit(DESCRIPTION_TAIL))).otherwise(t)


# Sentences of a venue's introduction.
INTRO_VISIT = "イベントや施設利用の立ち寄り先として訪れやすい場所です。"
INTRO_NEAR = "外出や用事の合間に訪れやすく、イベント参加や施設利用など幅広い目的で利用できます。"
INTRO_MORE = ["開催内容や混雑状況は日によって変わるため、訪問前に公式情報で最新の案内を確認するのがおすすめです。", "写真や口コミを参考にすると、現地の雰囲気をつかみやすくなります。"]
INTRO_MOST = 300


def introduction(name: Column, municipality: Column, category: Column) -> Column:
    """Two paragraphs about a venue; sentences of the second go from its end, but for the first, until it has 300 signs.
    If that is not enough it stays whole."""
    name, category = F.coalesce(F.nullif(name, F.lit("")), F.lit("名称不明")), F.coalesce(F.nullif(category, F.lit("")), F.lit("イベント施設"))
    town = F.nullif(municipality, F.lit(""))
    lead = F.concat(name, F.lit("は、"), F.coalesce(F.concat(town, F.lit("にある")), F.lit("")), category, F.lit("スポットです。" + INTRO_VISIT + "\n"), F.coalesce(F.concat(town, F.lit("周辺での")), F.lit("")), F.lit(INTRO_NEAR))
    tries = [F.concat(lead, F.lit("".join(INTRO_MORE[:k]))) for k in range(len(INTRO_MORE), -1, -1)]
    return F.coalesce(*(F.when(F.length(t) <= INTRO_MOST, t) for t in tries), tries[0])


def summary(category: Column, prefecture: Column, municipality: Column, text: Column) -> Column:
    """What a map's card says of a venue: category and area, else the first 30 signs of its text, else where to look."""
    filled = lambda c: F.nullif(c, F.lit(""))
    area = F.nullif(F.concat_ws(" ", filled(prefecture), filled(municipality)), F.lit(""))
    said = F.nullif(F.concat_ws(" / ", filled(category), area), F.lit(""))
    cut = F.when(F.length(text) > 30, F.concat(F.left(text, F.lit(30)), F.lit("…"))).otherwise(filled(text))
    return F.coalesce(said, cut, F.lit("詳細は下部カードをご覧ください"))


def is_excluded(title: Column) -> Column:
    """Closed days, what is not public, and rows without a title."""
    return title.isNull() | (normalize_space(title) == "") | contains_any(title, ["休館日", "非公開", "関係者のみ"])


def implied_end_range_of_list(text: Column) -> Column:
    """``struct(date_from, date_to)``: the first and last of several full dates; else the first one and the month and
    day after it, in the next year if that comes before it."""
    full = r"\d{4}\s*[年/.]\s*\d{1,2}\s*[月/.]\s*\d{1,2}\s*日?"

    def short_end(start: Column, rest: Column) -> Column:
        near = lambda p: make_date(F.year(start), F.get(p, 0), F.get(p, 1))
        end = once(F.regexp_extract(rest, r"\d{1,2}\s*[月/.]\s*\d{1,2}", 0), lambda t: F.when(t != "", once(F.split(t, r"\s*[月/.]\s*"), near)))
        return once(end, lambda e: F.coalesce(F.when(e < start, F.add_months(e, 12)).otherwise(e), start))

    def span(x: Column) -> Column:
        last = F.when(F.size(x["found"]) > 1, single_date(F.get(x["found"], F.size(x["found"]) - 1))).otherwise(short_end(x["start"], x["rest"]))
        return F.when(x["start"].isNotNull(), F.struct(x["start"].alias("date_from"), last.alias("date_to")))

    dated = lambda t: F.struct(F.regexp_extract_all(t, F.lit(f"({full})"), F.lit(1)).alias("found"), single_date(t).alias("start"), F.get(F.split(t, full, 2), 1).alias("rest"))
    return once(text, lambda t: once(dated(t), span))


def is_title_candidate(text: Column, keywords: list[str]) -> Column:
    """Two signs at least, with a keyword but more than it alone."""
    t = normalize_space(text)
    return F.coalesce((F.length(t) >= 2) & contains_any(t, keywords) & ~t.isin(keywords), F.lit(False))
