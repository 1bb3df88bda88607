"""Packing of tokenised documents into sequences of fixed length by best-fit decreasing.

Best-fit decreasing looks at nothing but lengths, and there are at most as many lengths as a sequence has tokens.
So the corpus is counted by length, the histogram is packed (a segment tree over remaining capacities gives the
tightest open bin in logarithmic time), and the runs of that plan are handed back to the pieces by their rank
among pieces of equal length.  The result is the best-fit-decreasing packing of the whole corpus at once; what the
driver holds depends on the sequence length alone.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .bpe import fast_ids
from .storage import Stash


class CapacityTree:
    """Which remaining capacities have open bins; finds the smallest one that is at least some length."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, capacity: int, there: bool) -> None:
        i = capacity + self.size
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        i = length + self.size
        while not self.any[i]:
            while i & 1:  # a right child: go up until something lies to the right
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank of the first piece, first bin, pieces a bin, offset in the bin) of the packing.

    Bins of equal remaining capacity are kept as ranges and equal pieces are placed a range at a time, which is
    what placing them one by one would do: a bin that has just taken a piece is the tightest for the next.
    """
    tree, open_, runs, bins = CapacityTree(capacity), defaultdict(list), [], 0
    open_: dict[int, list[tuple[int, int]]]

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_[room].append((first, n))
            tree.set(room, True)

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                each = capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                each = room // length
                first, n = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            use = min(n, -(-left // each))
            items = min(left, use * each)
            runs.append((length, rank, first, each, capacity - room))
            full = items // each
            put(room - each * length, first, full)
            if full < use:
                put(room - (items - full * each) * length, first + full, 1)
            put(room, first + use, n - use)
            rank, left = rank + items, left - items
    return runs


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: Broadcast, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    coder, part = fast_ids(tokenizer.value), TaskContext.get().partitionId()
    rank: dict[int, int] = defaultdict(int)
    for batch in T.slices(batches, 512):
        ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
        rows = []
        for i, tokens in zip(ids, coder.encode([t or "" for t in texts]), strict=True):
            tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
            at, cut = 0, len(tokens) % capacity or capacity
            for k in range(-(-len(tokens) // capacity)):
                rows.append((i, k, at, cut - at, zlib.crc32(tokens[at:cut].tobytes()), rank[cut - at]))
                rank[cut - at] += 1
                at, cut = cut, cut + capacity
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64() if j != 1 else pa.int32()) for j, c in enumerate(cols)), pa.array([part] * len(rows), pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"])
    coder.clear()  # the worker lives on


def _place(batches: Iterator[pa.RecordBatch], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    key = (runs[:, 0] << 44) + runs[:, 1]
    order = np.argsort(key)
    key, runs = key[order], runs[order]
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        run = runs[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
        nth = rank - run[:, 1]
        cols = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(run[:, 2] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the tokenizer's ids of its text and then ``end_id``; null and empty texts are ``end_id`` alone.
    Longer ones are cut into pieces of ``capacity``, of which the first may be shorter.  Every row is a document,
    repeated rows and null ids too; an empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "packing")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, part int"
    pieces = stash.put(rows.mapInArrow(lambda it: _pieces(it, tokenizer, capacity, end_id), schema))
    counts = stash.put(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    runs = np.array(plan(histogram, capacity) or [(0, 0, 0, 1, 0)], np.int64)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row a length and task, so it grows with the corpus and must not be broadcast: pieces are narrow rows to deal
    ranked = pieces.join(base.hint("merge"), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base")).drop("nth", "base", "part")
    return ranked.mapInArrow(lambda it: _place(it, runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
