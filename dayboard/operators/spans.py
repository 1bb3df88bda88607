"""Where a pattern matches in texts: offsets, contexts and segments, one row a match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alternate
from ..functions.values import once

# Elements of a block of running sums, signs of a part of a text.
BLOCK, PART = 64, 2048


def match_spans(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """``(keys, n, start, end, match, before, after)``: every match of a pattern, which must not match the empty text, in
    order from 0, with its offsets, what stands between it and the match before, and what follows up to the next one or
    to the end.

    One pass over a text cuts it at the matches; offsets are running sums of lengths.  Keys tell rows apart; null texts
    have no match.
    """
    cut = df.select(*keys, F.posexplode(alternate(F.col(text), pattern)).alias("_k", "_p"))
    so_far = Window.partitionBy(*keys).orderBy("_k")
    size = F.length("_p")
    placed = cut.select(*keys, "_k", F.col("_p").alias("match"), F.sum(size).over(so_far).alias("end"), F.lag("_p").over(so_far).alias("before"), F.lead("_p").over(so_far).alias("after"))
    return placed.where("_k % 2 = 1").select(*keys, F.floor(F.col("_k") / 2).cast("int").alias("n"), (F.col("end") - F.length("match")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), "match", "before", "after")


def _running(sizes: Column) -> Column:
    """Running sums of an array, by blocks: each step of an aggregate copies what it has so far."""
    last = lambda xs: F.coalesce(F.get(xs, F.size(xs) - 1), F.lit(0))
    sums = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda done, x: F.array_append(done, last(done) + x))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: sums(F.slice(sizes, b * BLOCK + 1, BLOCK)))
    whole = lambda bs: F.zip_with(bs, sums(F.transform(bs, last)), lambda own, end: F.transform(own, lambda x: end - last(own) + x))
    return F.flatten(once(blocks, whole))


def contexts(df: DataFrame, keys: list[str], text: str, pattern: str, before: int, after: int, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(keys, n, match, context)``: matches with so many signs before their start and after their end, as far as there
    are any.  ``where`` may filter the matches by their text before contexts are cut out.

    Offsets are running sums inside a text's row, and a context is cut out of the parts of the text that it lies in: no
    text is joined, broadcast, shuffled or repeated, and the work grows with the text's length.
    """
    cut = df.select(*keys, alternate(F.col(text), pattern).alias("_p"), F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0)).alias("_parts"))
    cut = cut.select("*", _running(F.transform("_p", F.length)).alias("_e"))
    found = F.filter(F.transform("_p", lambda p, i: F.struct(i.alias("k"), p.alias("match"))), lambda m: (m["k"] % 2 == 1) & (where(m["match"]) if where else F.lit(True)))
    span = lambda end, size: once(F.greatest(end - size - before, F.lit(0)), lambda a: F.struct(a.alias("a"), (end + after - a).alias("n")))
    held = lambda s: F.array_join(F.slice("_parts", (s["a"] / PART).cast("int") + 1, ((s["a"] % PART + s["n"]) / PART).cast("int") + 1), "")
    context = lambda m: once(span(F.get("_e", m["k"]), F.length(m["match"])), lambda s: F.substr(held(s), s["a"] % PART + 1, s["n"]))
    return cut.select(*keys, F.inline(F.transform(found, lambda m: F.struct(F.floor(m["k"] / 2).cast("int").alias("n"), m["match"].alias("match"), context(m).alias("context")))))
