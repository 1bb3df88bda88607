"""Readers of venue documents, venues, landed pages, tables and HTML trees."""

from __future__ import annotations

import gzip
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import SPOT, VENUE_DOCUMENT


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def venue_documents(spark: SparkSession, path: str, *, exclude: str = "template.json") -> DataFrame:
    """Venue documents with their file names; what cannot be parsed is kept in ``_corrupt_record``."""
    schema = StructType([*VENUE_DOCUMENT.fields, StructField("_corrupt_record", StringType())])
    docs = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return docs.select("*", F.col("_metadata.file_name").alias("file_name")).where(F.col("file_name") != exclude)


def latest_documents(docs: DataFrame) -> DataFrame:
    """Of several documents of a venue, the one in the last file."""
    key = F.coalesce("venue_id", F.regexp_replace("file_name", r"\.json$", ""))
    rest = [c for c in docs.columns if c != "venue_id"]
    return docs.groupBy(key.alias("venue_id")).agg(F.max_by(F.struct(*rest), "file_name").alias("d")).select("venue_id", "d.*")


def spots(spark: SparkSession, path: str) -> DataFrame:
    """Venues with an id and a name."""
    return spark.read.schema(SPOT).option("multiLine", True).json(path).where((F.col("spot_id") != "") & (F.col("name") != ""))


def html_tree(spark: SparkSession, path: str) -> DataFrame:
    """All .html files below a folder with path and time; dot files and partials are left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(path, wholetext=True)
    out = rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("html"))
    return out.where(~F.col("file_path").rlike(r"/\.[^/]*$|/partials/"))


def source_lines(spark: SparkSession, path: str, names: str = "*.js", exclude: str = "node_modules", where: Column | None = None) -> DataFrame:
    """``(file_path, line_no, line)`` of all files of a tree whose names match, without folders of the excluded name.

    Files are read in splits, large ones in several.  A line's number, from 1, is its place in its split and the number
    of the file's lines in the splits before, of which there is one count a split.  ``where`` filters lines, by
    ``line``, before they get numbers.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    rows = rows.where(~F.col("file_path").contains(f"/{exclude}/"))
    counts = rows.groupBy("file_path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file_path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    wanted = rows.where(where) if where is not None else rows
    return wanted.join(counts, ["file_path", "block"]).select("file_path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def paged_posts(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """``(page, body)`` of landed REST pages, files in folders ``page=1``, ``page=2``, ..: those that a client reads which
    asks for one after the other and stops at the first that is lacking or has no posts, at most ``most``.

    Which pages there are is known from the names of folders, so nothing behind a gap is opened; of the rest, what
    follows the first page without posts is left out.
    """
    rows = spark.read.option("wholetext", True).text(path)
    names = sorted({int(m[1]) for f in rows.inputFiles() if (m := re.search(r"/page=(\d+)/", f))})
    whole = [n for k, n in enumerate(names) if n == k + 1 and n <= most]
    pages = rows.where(F.col("page").isin(whole)).select(F.col("page").cast("int").alias("page"), F.col("value").alias("body"))
    full = F.coalesce(F.size(F.from_json("body", "array<string>")) > 0, F.lit(False))
    stop = pages.groupBy("page").agg(F.max(full).alias("full")).where("not full").agg(F.min("page")).first()[0]
    return pages if stop is None else pages.where(F.col("page") < stop)


NOINDEX = r"""(?i)<meta\s+name=["']robots["'][^>]*content=["'][^"']*noindex"""


def listed_pages(rows: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """Pages that a sitemap names, by paths relative to the site: without the frame of spots, files that prove ownership,
    and pages that are not to be indexed."""
    return rows.where((F.col(path) != "spot/index.html") & ~F.col(path).rlike(r"(?i)^google[\w-]*\.html$") & ~F.coalesce(F.col(html).rlike(NOINDEX), F.lit(False)))


def csv_cells(line: Column) -> Column:
    """Cells of a line of CSV: commas outside quotes split, quotes and outer spaces go."""
    return F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', "")))


def decode_bytes(body: Column, charset: str) -> Column:
    """Text of response bodies: gzip and zlib are recognised by their first bytes; what cannot be read is null."""

    def run(bodies: pd.Series) -> pd.Series:
        out = []
        for b in bodies:
            try:
                if b is not None and b[:2] == b"\x1f\x8b":
                    b = gzip.decompress(b)
                elif b is not None and b[:1] == b"\x78":
                    b = zlib.decompress(b)
                out.append(None if b is None else b.decode(charset))
            except (OSError, EOFError, zlib.error, UnicodeDecodeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(body)


def embedded_object(html: Column, name: str) -> Column:
    """Source of the object literal assigned to a variable, found by matching braces outside strings; null if none.

    The search goes from brace to brace and over whole strings, not from sign to sign.
    """
    start = re.compile(rf"\b{re.escape(name)}\s*=\s*\{{")
    step = re.compile(r"""[{}]|"(?:[^"\\]|\\.)*+(?:"|\Z)|'(?:[^'\\]|\\.)*+(?:'|\Z)""", re.S)

    def one(page: str | None) -> str | None:
        m = start.search(page or "")
        depth = 0
        for s in step.finditer(page, m.end() - 1) if m else ():
            depth += {"{": 1, "}": -1}.get(s[0], 0)
            if not depth:
                return page[m.end() - 1 : s.end()]
        return None

    return F.pandas_udf(lambda s: s.map(one), "string")(html)


def relaxed_json_map(text: Column) -> Column:
    """A map of strings from JSON with trailing commas or single quotes."""
    return F.from_json(F.regexp_replace(text, r",\s*([}\]])", "$1"), "map<string,string>", {"allowSingleQuotes": "true"})


def table_rows(html: Column) -> Column:
    """Arrays of cell texts, one for each row of the page's tables."""
    from ..functions.text import plain_text

    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), plain_text))


def api_posts(body: Column) -> Column:
    """Posts of a REST page: title, link and dates."""
    return F.from_json(body, "array<struct<title:struct<rendered:string>,link:string,acf:struct<start_date:string,end_date:string,detail_group:struct<e_start:string,e_start2:string,e_end:string,e_price:string,e_contact:string>>>>")
