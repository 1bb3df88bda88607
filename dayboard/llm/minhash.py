"""Near-duplicate documents by DartMinHash signatures and banded joins.

A text is a weighted set: its shingles of five words (lower case, words are runs of letters, digits and marks)
with their counts.  Each (shingle, weight unit, rank unit) cell holds a Poisson number of darts drawn from its
hash; a dart counts where it lies below the shingle's weight, and each of the signature's coordinates keeps its
dart of smallest rank.  Two texts agree in a coordinate with the probability of their weighted Jaccard
similarity, and a signature costs time in proportion to the shingles plus k log k.

Bands of coordinates are joined: every member of a bucket is first compared with one member of it (a star).  In
buckets that still hold more than one class, all pairs across classes are compared on the shingles themselves, in
blocks of bounded size; a block gives only the links that join its classes, fewer than it has rows.  So every pair
that shares a bucket and is similar enough ends in one class, however the rows are dealt.  In a bucket of
many classes that do not join, comparisons grow with their square, and so do the rows dealt into blocks, as each row
goes to every part of its bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .ann import groups
from .components import connected_components
from .storage import Stash

U64 = np.uint64
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, i + 1)) if i else np.exp(-1) for i in range(18)])


def weighted_shingles(text: str, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts.  Text without a word is one element of its own; blank text none."""
    h, _, _ = T.words(T.codes(text))
    if not len(h):
        bare = text.strip()
        return (np.frombuffer(hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "<u8"), np.ones(1, np.int64)) if bare else (np.empty(0, U64), np.empty(0, np.int64))
    return np.unique(T.shingles(h, n_words), return_counts=True)


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The id of the earliest dart in each of k coordinates, for elements with positive weights."""
    weights = np.asarray(weights, float)
    reach = (k * log(k) + 2 * k) / weights.sum()
    units = np.ceil(weights).astype(np.int64)
    unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    cell = T.mix(np.repeat(elements, units) + T.mix(unit.astype(U64) + U64(seed << 32)))
    room = np.repeat(weights, units) - unit  # below 1 only in the last unit of a fractional weight
    whole = bool((room >= 1).all())
    while True:
        ranks = ceil(reach)
        deep = cell if ranks == 1 else (cell[:, None] + np.arange(ranks, dtype=U64)[None, :] * U64(0xD6E8FEB86659FD93)).ravel()
        deep = T.mix(deep)
        count = np.searchsorted(_POISSON, (deep >> U64(11)) * 2.0**-53, side="right")
        dart = np.repeat(deep, count)
        nth = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
        dart = T.mix(dart + (nth + 1).astype(U64) * U64(0xA0761D6478BD642F))
        rank = (dart >> U64(11)) * 2.0**-53
        if ranks > 1:
            rank = rank + np.repeat(np.tile(np.arange(ranks), len(cell)), count)
        keep = rank < reach
        if not whole:
            keep &= (T.mix(dart ^ U64(0x5851F42D4C957F2D)) >> U64(11)) * 2.0**-53 < np.repeat(np.repeat(room, ranks), count)
        dart, rank = dart[keep], rank[keep]
        place = ((T.mix(dart) >> U64(32)) * U64(k)) >> U64(32)
        late_first = np.argsort(-rank, kind="stable")
        out = np.zeros(k, U64)
        out[place[late_first]] = dart[late_first]  # the last one assigned is the earliest dart
        if out.all():
            return out
        reach *= 2


def _signatures(batches: Iterator[pa.RecordBatch], n_words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        digest, size, keys = [], [], []
        for text in batch.column("text").to_pylist():
            el, w = weighted_shingles(text or "", n_words)
            if not len(el):
                digest.append(None), size.append(0), keys.append([])
                continue
            sig = dart_signature(el, w, bands * rows)
            digest.append(_digest(text, el))
            size.append(int(w.sum()))
            part = np.zeros(bands, U64)
            for column in sig.reshape(bands, rows).T:
                part = T.mix(part + column)
            keys.append(T.mix(part + np.arange(bands, dtype=U64)).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "size", "keys"])


def _digest(text: str, elements: np.ndarray) -> bytes:
    """The words in order say whether texts are copies; a text without a word is its only element."""
    h, _, _ = T.words(T.codes(text))
    return hashlib.blake2b((h if len(h) else elements).tobytes(), digest_size=16).digest()


def _occurrences(batches: Iterator[pa.RecordBatch], n_words: int) -> Iterator[pa.RecordBatch]:
    """Each shingle with its ordinal among equal ones: sets of these have the weighted similarity of the texts."""
    for batch in T.slices(batches):
        ids, out = [], []
        for i, text, digest in zip(*(batch.column(n).to_pylist() for n in ("id", "text", "digest")), strict=True):
            el, w = weighted_shingles(text or "", n_words)
            if len(el) and _digest(text, el) == digest:  # not another text under the same id
                nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                ids.append(i), out.append(T.mix(np.repeat(el, w) + nth.astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64))
        off = np.cumsum([0, *map(len, out)]).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), items], names=["id", "items"])


def _near_size(threshold: float) -> Column:
    return F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold - 1e-9


def _block_links(ids: np.ndarray, label: np.ndarray, off: np.ndarray, values: np.ndarray, part: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Links that join the classes of a block as all its pairs at the threshold would: pairs inside one class are skipped."""
    n, size = len(ids), np.diff(off)
    comp = np.unique(label, return_inverse=True)[1]
    if not comp.any():
        return [], []
    _, code, often = np.unique(values[off[0] : off[-1]], return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    holder = np.repeat(np.arange(n), size)[order]
    first, off = np.cumsum(often) - often, off - off[0]
    # items that rows of one class hold alone link no classes
    crosses = np.maximum.reduceat(comp[holder], first) != np.minimum.reduceat(comp[holder], first)
    a, b = [], []
    for i in np.flatnonzero(part == hi):
        if (comp == comp[i]).all():
            break
        mine = code[off[i] : off[i + 1]]
        mine = mine[crosses[mine]]
        if len(mine) < size[i] * threshold - 1e-9:  # what both hold is that share of either
            continue
        many = often[mine]
        common = np.bincount(holder[np.repeat(first[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=n)
        ok = (common >= (size[i] + size - common) * threshold - 1e-9) & (comp != comp[i])
        if lo[i] != hi[i]:
            ok &= part != part[i]  # pairs inside a part are compared in the part's own block
        for j in np.flatnonzero(ok):
            if comp[j] != comp[i]:
                a.append(int(min(ids[i], ids[j]))), b.append(int(max(ids[i], ids[j])))
                comp[comp == comp[j]] = comp[i]
    return a, b


def _across(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between classes inside each block of rows."""
    for t, starts in groups(batches, "block"):
        ids, label, part, lo, hi = (t.column(c).to_numpy() for c in ("id", "label", "part", "lo", "hi"))
        items = t.column("items").combine_chunks()
        off, values = items.offsets.to_numpy(), items.values.to_numpy()
        a, b = [], []
        for x, y in zip(starts, [*starts[1:], t.num_rows], strict=True):
            found = _block_links(ids[x:y], label[x:y], off[x : y + 1], values, part[x:y], lo[x:y], hi[x:y], threshold)
            a += found[0]
            b += found[1]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class _Verifier:
    """Checks candidate pairs: sizes first, then the shingles of the texts that are left."""

    def __init__(self, reps: DataFrame, items: DataFrame, stash: Stash, threshold: float):
        self.reps, self.items, self.stash, self.threshold = reps, items, stash, threshold

    def plausible(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.reps.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(_near_size(self.threshold)).select("a", "b")

    def links(self, near: DataFrame) -> DataFrame:
        of = lambda x: self.items.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}"))
        both = near.join(of("a"), "a").join(of("b"), "b").withColumn("common", F.size(F.array_intersect("items_a", "items_b")))
        union = F.size("items_a") + F.size("items_b") - F.col("common")
        return self.stash.put(both.where(F.col("common") >= union * self.threshold - 1e-9).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n_words: int = 5, threshold: float = 0.8, bands: int = 25, rows: int = 6, block_rows: int = 1024, block_items: int = 1 << 20) -> DataFrame:
    """One row ``(id_col, class_id, n_shingles)`` per input row; ``class_id`` is the smallest id of its class.

    Texts with the same words in order are copies and share a class; so do texts joined by a chain of pairs whose
    weighted Jaccard similarity is at least ``threshold``.  Null and blank texts are each a class of their own; a
    null id gives a null class.  Rows that repeat an id give one row each; if their texts differ, each row has the
    class of its own text, and of those texts that no smaller id has, the one of least digest stands for the id.
    Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = stash.put(texts.mapInArrow(lambda it: _signatures(it, n_words, bands, rows), "id long, digest binary, size long, keys array<long>"))
    known = sigs.where("id is not null and digest is not null")
    first = known.groupBy("digest").agg(F.min("id").alias("rep"))
    of_rep = known.join(first.withColumnRenamed("rep", "id"), ["digest", "id"])
    reps = stash.put(of_rep.groupBy("id").agg(F.min(F.struct("digest", "size", "keys")).alias("r")).select("id", "r.*"))

    members = reps.select("id", "size", F.posexplode("keys").alias("band", "key"))
    # the center of a bucket: the least hash, which near copies mostly share whatever the band
    draw = F.struct(F.xxhash64("id").alias("draw"), F.col("id").alias("id"))
    centers = members.groupBy("key").agg(F.min(draw).alias("c"), F.count("*").alias("n")).where("n > 1").select("key", F.col("c.id").alias("center"))
    shared = stash.put(members.join(centers, "key"))
    ids = reps.select("id", "digest").join(shared.select("id").distinct(), "id", "left_semi")
    items = stash.put(texts.join(ids, "id").mapInArrow(lambda it: _occurrences(it, n_words), "id long, items array<long>").dropDuplicates(["id"]))
    check = _Verifier(reps, items, stash, threshold)
    stars = shared.where("id <> center").select(F.least("id", "center").alias("a"), F.greatest("id", "center").alias("b")).distinct()
    links = check.links(check.plausible(stars))
    labels = connected_components(links, stash)

    # buckets that still hold several classes: all pairs across classes.  Large buckets are dealt into parts by hash,
    # and each pair of parts is a block of its own
    named = shared.drop("center").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    parts = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") / block_items)).cast("int")
    split = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), parts.alias("parts")).where("least < most and n > 2").select("key", "parts")
    dealt = named.join(split, "key").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("id", "label", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "key")
    dealt = dealt.withColumn("block", F.xxhash64("key", "lo", "hi")).drop("key").join(items, "id")
    across = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _across(it, threshold), "a long, b long")
    more = stash.put(across.distinct())
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more), stash)

    classes = stash.put(labels)
    of_copy = first.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("class"))
    out = sigs.join(of_copy, "digest", "left").select("id", F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class_id"), F.col("size").alias("n_shingles"))
    return out.select(F.col("id").alias(id_col), "class_id", "n_shingles")
