"""Removal of repeated lines, paragraphs and runs of sentences across a corpus.

Units are lines, paragraphs of several lines, and runs of sentences: from each sentence on, as many as are needed
to reach a number of words, so that a passage that stands inside a longer line goes whole, its short sentences too.
Each unit is normalised (lower case, single spaces) and hashed; over the whole corpus the occurrence with the
smallest (document id, offset) stays and the others go.  Units of few words ("Yes.", headings, lone sentences that
many authors write) are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .storage import Stash

#: A sentence with its line end, or what is left of a line; these cover a text without gaps.
UNIT = r"[^.!?\n]*(?:[.!?]+[ \t]*\n?|\n)|[^.!?\n]+"
_UNIT = re.compile(UNIT)


def units(text: str, least_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of every unit that has enough words, each span once; a paragraph ends at a blank line."""
    start, end, said, n, line, para = [], [], [], [], [], []
    lines = paras = 0
    blank, fresh = True, False  # whether the line so far has no word, and whether a line has just ended
    for m in _UNIT.finditer(text):
        words = m[0].lower().encode("utf-8", "surrogatepass").split()
        if fresh:
            lines, blank, fresh = lines + 1, True, False
        fresh = m[0].endswith("\n")
        if words:
            start.append(m.start()), end.append(m.end()), said.append(b" ".join(words)), n.append(len(words)), line.append(lines), para.append(paras)
            blank = False
        elif fresh and blank:
            paras += 1
    out: dict[tuple[int, int], bytes] = {}

    def add(i: int, j: int) -> None:
        span = (start[i], end[j])
        if span not in out:
            out[span] = hashlib.md5(b" ".join(said[i : j + 1])).digest()

    for group in (line, para):
        i = 0
        for j in range(len(group)):
            if j + 1 == len(group) or group[j + 1] != group[i]:
                if sum(n[i : j + 1]) >= least_words:
                    add(i, j)
                i = j + 1
    j, have = 0, 0  # sentences i to j - 1 are the run from i on
    for i in range(len(n)):
        while have < least_words and j < len(n) and para[j] == para[i]:
            have += n[j]
            j += 1
        if have >= least_words:
            add(i, j - 1)
        have -= n[i]
    return [(a, b, d) for (a, b), d in out.items()]


def _units(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "start", "end", "digest"]
    for batch in T.slices(batches):
        ids, start, end, digest = [], [], [], []
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for a, b, d in units(text, least_words):
                ids.append(i), start.append(a), end.append(b), digest.append(d)
            if len(ids) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())], names=names)
                ids, start, end, digest = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())], names=names)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merged(spans: DataFrame) -> DataFrame:
    """``(id, start, end)`` -> ``(id, spans)``: overlapping and touching spans of a document joined, in order."""
    before = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)
    so_far = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(so_far))
    whole = island.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _kept(text: Column, start: Column, end: Column) -> Column:
    """The text outside the spans."""
    ends = F.concat(start, F.array(F.length(text)))
    parts = F.zip_with(F.concat(F.array(F.lit(0)), end), ends, lambda a, b: F.substr(text, a + 1, b - a))
    return F.array_join(parts, "")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_words: int = 20, out_col: str = "deduped") -> DataFrame:
    """``docs`` with a struct column ``out_col``: ``text`` without repeats, and the ``start`` and ``end`` offsets
    (in code points of the original, end exclusive, merged and in order) of what was removed.

    Units have ``least_words`` words or more.  The first occurrence by (id, offset) of every unit stays, and so do
    occurrences that overlap it.  Rows that share an id are one document, so their units tie and are all kept or all
    removed.  Null texts stay null, empty ones empty; rows with a null id are returned as they are and count as no
    occurrence.  An existing column named ``out_col`` is replaced; columns named like inner ones do not matter.
    """
    stash = Stash(docs.sparkSession, "substring")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    # computed twice, as texts are read again in less space and time than all units are written and read
    found = rows.mapInArrow(lambda it: _units(it, least_words), "id long, start int, end int, digest binary")
    first = found.groupBy("digest").agg(F.min(F.struct("id", "start", "end")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # a table of its own, so that the join's other side can be split where a digest is frequent
    first = stash.put(first.select("digest", F.col("first.id").alias("first_id"), F.col("first.end").alias("first_end")))
    gone = found.join(first, "digest").where("id > first_id or start >= first_end").select("id", "start", "end")
    spans = _merged(gone).select(F.col("id").alias("_repeat_id"), F.col("spans.start").alias("_repeat_start"), F.col("spans.end").alias("_repeat_end"))
    joined = docs.join(spans, docs[id_col].cast("long") == spans["_repeat_id"], "left")
    text, none = docs[text_col], F.array().cast("array<int>")
    hit = text.isNotNull() & F.col("_repeat_id").isNotNull()
    out = F.struct(
        F.when(hit, F.col("_repeat_start")).otherwise(none).alias("start"),
        F.when(hit, F.col("_repeat_end")).otherwise(none).alias("end"),
        F.when(hit, _kept(text, F.col("_repeat_start"), F.col("_repeat_end"))).otherwise(text).alias("text"),
    )
    return joined.withColumn(out_col, out).drop("_repeat_id", "_repeat_start", "_repeat_end")
