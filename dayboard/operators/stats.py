"""Counts, rates and quality decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attribute, is_blank
from ..functions.values import rate_status


def quality_gate(events: DataFrame, group: list[str], title: Column, dated: Column, warn: float = 0.01, fail: float = 0.03) -> DataFrame:
    """Totals, missing titles and dates, their rates and the status of the worse one."""
    out = events.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(is_blank(title)).alias("missing_title"), F.count_if(~dated).alias("missing_date"))
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    out = out.withColumns({"title_rate": rate("missing_title"), "date_rate": rate("missing_date")})
    worst = F.greatest("title_rate", "date_rate")
    return out.withColumn("status", F.when(F.col("total") == 0, "warn").otherwise(rate_status(worst, warn, fail)))


def filter_summary(rows: DataFrame, group: str, keep: Column) -> DataFrame:
    """Rows before, after and removed, for each group."""
    out = rows.groupBy(group).agg(F.count("*").alias("before"), F.count_if(keep).alias("after"))
    return out.withColumn("removed", F.col("before") - F.col("after"))


def histogram(rows: DataFrame, key: str, first_seen: str) -> DataFrame:
    """Counts, most first; ties in order of first appearance."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(first_seen).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def top_tokens(rows: DataFrame, group: str, tokens: Column, ordinal: str, least: int = 3, top: int = 30) -> DataFrame:
    """The most frequent tokens of each group that occur ``least`` times; ties in order of first appearance."""
    each = rows.select(group, ordinal, F.posexplode(tokens).alias("at", "token"))
    counts = each.groupBy(group, "token").agg(F.count("*").alias("n"), F.min(F.struct(ordinal, "at")).alias("seen")).where(F.col("n") >= least)
    w = Window.partitionBy(group).orderBy(F.desc("n"), "seen")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).drop("seen")


def over_fixed_list(spark, names: list[str], key: str, counts: DataFrame, columns: list[str]) -> DataFrame:
    """The counts in the order of a fixed list, 0 where there are none."""
    fixed = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{key} string, list_ord int")
    return fixed.join(counts, key, "left").select(key, "list_ord", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def date_bag(dates: Column) -> Column:
    """``struct(date_from, date_to)``: the earliest and latest; null if any is missing or there are none."""
    bad = F.exists(dates, lambda d: d.isNull()) | (F.size(dates) == 0)
    return F.when(~bad, F.struct(F.array_min(dates).alias("date_from"), F.array_max(dates).alias("date_to")))


def violations(events: DataFrame, ordinal: str) -> DataFrame:
    """The first rule that each bad row breaks."""
    why = F.when(F.col("title").isNull() | (F.length("title") < 2), "title").when(F.col("date_from").isNull() | ~F.col("date_from").rlike(r"^\d{4}-\d{2}-\d{2}$"), "date_from")
    return events.select(ordinal, why.alias("violation")).where("violation is not null")


class InvalidEvents(ValueError):
    """Raised by :func:`require_valid` with the first violation."""


def require_valid(events: DataFrame, ordinal: str, least: int = 1) -> DataFrame:
    """``events``, or an error for the first violation or if there are too few."""
    first = violations(events, ordinal).orderBy(ordinal).first()
    if first is not None:
        raise InvalidEvents(f"row {first[0]}: {first[1]}")
    if len(events.limit(least).take(least)) < least:
        raise InvalidEvents(f"fewer than {least} events")
    return events


def dated_rows(events: DataFrame, column: str = "date_from") -> int:
    """How many rows have a first day."""
    return events.agg(F.count_if(~is_blank(F.col(column).cast("string")))).first()[0]


def require_dated(events: DataFrame, column: str = "date_from", least: int = 1) -> DataFrame:
    """``events``, or an error if fewer than ``least`` of them have a first day, as when there are none at all."""
    found = dated_rows(events, column)
    if found < least:
        raise InvalidEvents(f"{found} rows with a {column}, {least} wanted")
    return events


def conflict_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that begin with a merge-conflict marker, with their numbers from 1."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike(CONFLICT)).select(key, (F.col("n") + 1).alias("line_no"), "line")


#: What a line with a merge-conflict marker begins with.
CONFLICT = r"^(<{7}|={7}|>{7})(\s|$)"


def conflicts_in_tree(spark, path: str) -> DataFrame:
    """``(file_path, line_no, line)`` of conflict markers in the sources below a folder."""
    from ..sources.readers import source_lines

    return source_lines(spark, path, where=F.col("line").rlike(CONFLICT))


# What each page of a site must have.
SEO_MARKERS = {
    "title": r"(?i)<title>[^<]+</title>",
    "description": r"""(?i)<meta\s+name=["']description["'][^>]*>""",
    "canonical": r"""(?i)<link\s+rel=["']canonical["'][^>]*>""",
    "og:url": r"""(?i)<meta\s+property=["']og:url["'][^>]*>""",
    "og:image": r"""(?i)<meta\s+property=["']og:image["'][^>]*>""",
    "og:image:alt": r"""(?i)<meta\s+property=["']og:image:alt["'][^>]*>""",
    "twitter:title": r"""(?i)<meta\s+name=["']twitter:title["'][^>]*>""",
    "twitter:description": r"""(?i)<meta\s+name=["']twitter:description["'][^>]*>""",
}


# Tags of which two must hold the same address, if both are there.
SAME_ADDRESS = {
    "canonical <> og:url": ((r"""(?i)<link\s+rel=["']canonical["'][^>]*>""", "href"), (r"""(?i)<meta\s+property=["']og:url["'][^>]*>""", "content")),
    "og:image <> twitter:image": ((r"""(?i)<meta\s+property=["']og:image["'][^>]*>""", "content"), (r"""(?i)<meta\s+name=["']twitter:image["'][^>]*>""", "content")),
}


def seo_problems(pages: DataFrame, key: str, html: str, hub: Column | None = None) -> DataFrame:
    """One row for each marker that a page lacks, each pair of addresses that differ, and for hubs without JSON-LD."""
    page = F.col(html)
    found = [F.when(~page.rlike(p), F.lit(k)) for k, p in SEO_MARKERS.items()]
    for k, (a, b) in SAME_ADDRESS.items():
        found.append(F.when(attribute(page, *a) != attribute(page, *b), F.lit(k)))
    if hub is not None:
        found.append(F.when(hub & ~page.rlike(r"""(?i)<script[^>]+type=["']application/ld\+json["']"""), F.lit("application/ld+json")))
    return pages.select(key, F.explode(F.array_compact(F.array(*found))).alias("problem"))


def missing_references(texts: DataFrame, key: str, text: str, existing: DataFrame, path: str) -> DataFrame:
    """``(key, reference)``: paths between backticks in a text, each once, for which there is no file."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"`([\w./-]+\.[a-z]+)`"), F.lit(1)))
    return texts.select(key, F.explode(found).alias("reference")).join(existing.select(F.col(path).alias("reference")), "reference", "left_anti").select(key, "reference")


def column_widths(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the length of the longest cell of each column."""
    return rows.agg(*(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in columns))


def latest(rows: DataFrame, column: str):
    """The latest number of a column, 0 if there is none."""
    return rows.agg(F.coalesce(F.max(column), F.lit(0)).alias(column)).first()[0]


def problem_count(*problems: DataFrame) -> int:
    """How many problems some checks have found together."""
    return sum(p.count() for p in problems)


def report(rows: DataFrame, name: str, numbers: list[str]) -> DataFrame:
    """``(ord, line)``: a table as text, names to the left and numbers to the right, each column as wide as its longest
    cell or heading; a heading, a rule, and a line a row by name."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (name, *numbers)]
    widths = rows.agg(*(F.coalesce(F.max(F.length(c)), F.lit(0)) for c in cells)).first()
    widths = [widths[0], *(max(w, len(n)) for w, n in zip(widths[1:], numbers, strict=True))]
    head = " | ".join([name.ljust(widths[0]), *(n.rjust(w) for n, w in zip(numbers, widths[1:], strict=True))])
    top = rows.sparkSession.createDataFrame([(0, "", head), (1, "", "-+-".join("-" * w for w in widths))], "ord int, name string, line string")
    line = F.concat_ws(" | ", F.rpad(cells[0], widths[0], " "), *(F.lpad(c, w, " ") for c, w in zip(cells[1:], widths[1:], strict=True)))
    out = top.unionByName(rows.select(F.lit(2).alias("ord"), cells[0].alias("name"), line.alias("line")))
    return out.orderBy("ord", "name").select("ord", "line")
