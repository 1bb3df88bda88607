"""Spelling variants in a vocabulary: pairs of words one edit apart, by composition of finite automata.

The vocabulary is an acceptor V.  Composed with the transducer E of exactly one inserted, deleted or replaced code
point and with V again, V o E o V accepts the pairs of near words.  A state of the composition is two states of V and
whether the edit has been made; before the edit both are the same state, after it both read the same letters.

The composition is cut by the states it can be entered at.  Two near words of which the shorter has m letters share
the first ``lo`` letters and the last ``m - hi`` if the edit lies at a place in [lo, hi), so words are dealt into
blocks of equal (m, lo, hi, first letters, last letters): a block is the partition of one state of V, that after the
first letters, with the last letters cut off.  Three ranges of places cover every word, each pair is met in one
block only (the edit is at the first place where the words differ), and a task builds the minimal acceptor of its
blocks and runs the composition from the initial state of each.  Blocks of more than ``block_words`` words are dealt
anew with their range halved, until a range is one place; then the alphabet bounds the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .storage import Stash

_SHIFT = 21  # bits of a code point


@dataclass
class Acceptor:
    """A minimal acyclic acceptor.  Edges of a state stand together by rising label; ``skip`` is the number of the
    state's words that come before those through the edge, so the skips along a path add up to the word's number."""

    first: np.ndarray  # of each state's edges, and their end
    label: np.ndarray
    target: np.ndarray
    skip: np.ndarray
    final: np.ndarray
    initial: np.ndarray  # the state of each block

    def __post_init__(self):
        self._keys = (np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) << _SHIFT) | self.label

    def degree(self, q: np.ndarray) -> np.ndarray:
        return self.first[q + 1] - self.first[q]

    def edges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges of the states, and which state each is of."""
        n = self.degree(q)
        of = np.repeat(np.arange(len(q)), n)
        return self.first[q][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of

    def step(self, q: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The edge of each state with the label, or -1."""
        if not len(self._keys):
            return np.full(len(q), -1)
        want = (q << _SHIFT) | label
        at = np.minimum(np.searchsorted(self._keys, want), len(self._keys) - 1)
        return np.where(self._keys[at] == want, at, -1)


def minimal_acceptor(codes: np.ndarray, off: np.ndarray, block: np.ndarray) -> Acceptor:
    """Of distinct words in code-point order inside each block (numbered from 0 in order).

    The trie is read off the sorted words level by level, then states with the same finality and the same edges are
    made one, from the deepest level up; states of all blocks are shared.
    """
    size = np.diff(off)
    parent, node, label = [], [], []
    of = block.astype(np.int64)  # the node that each word stands at
    n_nodes = roots = int(block[-1]) + 1 if len(block) else 0
    start = [np.flatnonzero(np.diff(block, prepend=-1))]
    rows = np.arange(len(size))
    ends = []
    depth = 0
    while len(rows):
        ends.append(of[size[rows] == depth])
        live = size[rows] > depth
        rows, at = rows[live], of[live]
        if not len(rows):
            break
        c = codes[off[rows] + depth].astype(np.int64)
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (c[1:] != c[:-1])])
        of = n_nodes + np.cumsum(new) - 1
        parent.append(at[new]), label.append(c[new]), node.append(of[new]), start.append(rows[new])
        n_nodes += int(new.sum())
        depth += 1
    begin = np.concatenate(start)
    final = np.zeros(n_nodes, bool)
    for e in ends:
        final[e] = True
    state = np.zeros(n_nodes, np.int64)
    seen: dict[bytes, int] = {}
    shape: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    empty = np.empty(0, np.int64)
    for d in range(len(parent), -1, -1):
        mine = node[d - 1] if d else np.arange(roots)
        if d < len(parent):
            edge = (label[d] << 40) | state[node[d]]
            a, b = np.searchsorted(parent[d], mine), np.searchsorted(parent[d], mine, side="right")
            skips = begin[node[d]] - begin[parent[d]]
        else:
            edge, skips = empty, empty
            a = b = np.zeros(len(mine), np.int64)
        done = final[mine]
        for k in range(len(mine)):
            x, y = a[k], b[k]
            key = edge[x:y].tobytes() + (b"+" if done[k] else b"")
            s = seen.get(key)
            if s is None:
                s = seen[key] = len(shape)
                shape.append((edge[x:y], skips[x:y], done[k]))
            state[mine[k]] = s
    edges = np.concatenate([s[0] for s in shape]) if shape else empty
    first = np.cumsum([0, *(len(s[0]) for s in shape)])
    skip = np.concatenate([s[1] for s in shape]) if shape else empty
    return Acceptor(first, edges >> 40, edges & ((1 << 40) - 1), skip, np.array([s[2] for s in shape], bool), state[:roots])


def near_pairs(v: Acceptor, base: np.ndarray, width: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of word numbers that V o E o V accepts, from the initial state of each block.

    ``base`` is the number of a block's first word, ``width`` the letters of its shorter words that are left, and
    ``last`` whether the edit may lie behind them.  The shorter word comes second.
    """
    found_a, found_b = [], []
    q, i, left, last = v.initial, base.astype(np.int64), width.astype(np.int64), last.astype(bool)
    pairs = [np.empty(0, np.int64) for _ in range(5)]  # states and numbers of both words, and letters left to a replacement (-1: any)
    fresh = [np.empty(0, np.int64) for _ in range(5)]  # after an insertion: states, numbers, and the label read
    while len(q) or len(pairs[0]) or len(fresh[0]):
        # after the edit, both read the same letter
        p, r, a, b, more = (np.concatenate([x, y]) for x, y in zip(pairs, [*fresh[:4], np.full(len(fresh[4]), -1)], strict=True))
        ban = np.concatenate([np.full(len(pairs[0]), -1), fresh[4]])
        swap = v.degree(p) > v.degree(r)
        e, of = v.edges(np.where(swap, r, p))
        other = v.step(np.where(swap, p, r)[of], v.label[e])
        ok = (other >= 0) & (v.label[e] != ban[of]) & (more[of] != 0)
        e, other, of = e[ok], other[ok], of[ok]
        x, y = np.where(swap[of], other, e), np.where(swap[of], e, other)
        after = [v.target[x], v.target[y], a[of] + v.skip[x], b[of] + v.skip[y], np.maximum(more[of] - 1, -1)]
        # the edit: two labels of a state, or a label that one word alone reads
        e, of = v.edges(q)
        inside = left[of] > 0
        n = v.degree(q)[of] - (e - v.first[q[of]]) - 1
        n[~inside] = 0
        f = np.repeat(np.arange(len(e)), n)
        g = e[f] + 1 + np.arange(len(f)) - np.repeat(np.cumsum(n) - n, n)
        f_, fo = e[f], of[f]
        swapped = [v.target[f_], v.target[g], i[fo] + v.skip[f_], i[fo] + v.skip[g], left[fo] - 1]
        pairs = [np.concatenate(z) for z in zip(after, swapped, strict=True)]
        may = inside | last[of]
        fresh = [v.target[e[may]], q[of[may]], i[of[may]] + v.skip[e[may]], i[of[may]], v.label[e[may]]]
        # accepted: both at a final state; a replacement only with as many letters as the shorter words have
        done = v.final[pairs[0]] & v.final[pairs[1]] & (pairs[4] <= 0)
        found_a.append(pairs[2][done]), found_b.append(pairs[3][done])
        done = v.final[fresh[0]] & v.final[fresh[1]]
        found_a.append(fresh[2][done]), found_b.append(fresh[3][done])
        keep = pairs[4] != 0
        pairs = [z[keep] for z in pairs]
        # before the edit
        e, of = e[inside], of[inside]
        q, i, left, last = v.target[e], i[of] + v.skip[e], left[of] - 1, last[of]
    return np.concatenate(found_a or [np.empty(0, np.int64)]), np.concatenate(found_b or [np.empty(0, np.int64)])


def _best_near(table: pa.Table) -> pa.RecordBatch:
    """For each row that has near words in its blocks: their number, and the most frequent, first in order if tied."""
    words, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
    m, lo, hi, block = (table.column(c).to_numpy() for c in ("m", "lo", "hi", "block"))
    starts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
    of = np.cumsum(np.diff(block, prepend=block[:1]) != 0)
    middle = table.column("middle").combine_chunks()
    off = np.concatenate([[0], np.cumsum(pc.utf8_length(middle).to_numpy().astype(np.int64))])
    v = minimal_acceptor(T.codes("".join(middle.to_pylist())), off, of)
    a, b = near_pairs(v, starts, (hi - lo)[starts], (hi == m)[starts])
    rank = pc.rank(words, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    one, two = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((rank[two], -n[two], one))
    one, two = one[order], two[order]
    at = np.flatnonzero(np.diff(one, prepend=-1))
    near = np.diff(np.append(at, len(one)))
    return pa.RecordBatch.from_arrays([words.take(pa.array(one[at])), pa.array(near, pa.int64()), pa.array(-n[two[at]], pa.int64()), words.take(pa.array(two[at]))], names=["word", "near", "minus_n", "best"])


def _compose(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Whole blocks of sorted rows, about ``rows`` at a time."""
    kept: list[pa.Table] = []
    held = 0
    for batch in batches:
        kept.append(pa.Table.from_batches([batch]))
        held += batch.num_rows
        if held >= rows:
            t = pa.concat_tables(kept).combine_chunks()
            block = t.column("block").to_numpy()
            cut = int(np.searchsorted(block, block[-1]))  # the last may go on
            if cut:
                yield _best_near(t.slice(0, cut))
                t = t.slice(cut).combine_chunks()
            kept, held = [t], t.num_rows
    if held:
        yield _best_near(pa.concat_tables(kept).combine_chunks())
    pa.default_memory_pool().release_unused()


def _cut(lo: Column, hi: Column, width: Column) -> Column:
    """Ranges of ``width`` places that cover [lo, hi)."""
    return F.transform(F.sequence(lo, hi - 1, width), lambda x: F.struct(x.alias("lo"), F.least(x + width, hi).alias("hi")))


def _shared(word: str = "word") -> Column:
    """What the words of a block share, in one column."""
    return F.concat_ws("\x00", F.col("m"), F.col("lo"), F.col("hi"), F.expr(f"left({word}, lo)"), F.expr(f"right({word}, m - hi)"))


def near_words(words: DataFrame, stash: Stash, block_words: int = 4096, task_rows: int = 30_000) -> DataFrame:
    """``(word, near, minus_n, best)`` partial rows of each of ``words(word, n)`` that has near words: to be summed,
    and of (minus_n, best) the least taken.  Words are distinct and not empty."""
    least = words.agg(F.min(F.length("word"))).first()[0]
    size = F.length("word")
    lengths = F.filter(F.array(size - 1, size), lambda x: x >= (least or 1))  # of the shorter word
    third = lambda x: F.ceil(x / 3).cast("int")
    places = F.flatten(F.transform(lengths, lambda m: F.transform(_cut(F.lit(0), m, third(m)), lambda r: F.struct(m.alias("m"), r["lo"].alias("lo"), r["hi"].alias("hi")))))
    dealt = words.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.*")
    out = None
    while True:
        key = F.xxhash64(_shared())
        # hot by the hash: a block that shares it with a hot one is dealt anew with it, which does no harm
        hot = stash.put(dealt.groupBy(key.alias("block")).agg(F.count("*").alias("rows"), F.max(F.col("hi") - F.col("lo")).alias("width")).where(f"rows > {block_words} and width > 1").select("block"))
        rest = None
        if not hot.isEmpty():
            keyed = stash.put(dealt.withColumn("block", key).join(hot.withColumn("hot", F.lit(True)), "block", "left"))
            wide = F.col("hot").isNotNull() & (F.col("hi") - F.col("lo") > 1)
            half = F.ceil((F.col("hi") - F.col("lo")) / 2).cast("int")
            rest = keyed.where(wide).select("word", "n", "m", F.explode(_cut(F.col("lo"), F.col("hi"), half)).alias("p")).select("word", "n", "m", "p.*")
            dealt = keyed.where(~wide).select("word", "n", "m", "lo", "hi")
        # only words travel; what a block shares and what is left are cut out again behind the shuffle
        rows = dealt.repartition(_shared()).withColumns({"shared": _shared(), "middle": F.expr("substring(word, lo + 1, length(word) - lo - (m - hi))")})
        rows = rows.sortWithinPartitions("shared", "middle")
        found = rows.mapInArrow(lambda it: _compose(_numbered(it), task_rows), "word string, near long, minus_n long, best string")
        out = found if out is None else out.unionByName(found)
        if rest is None:
            return out
        dealt = rest


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``shared``, with the number of each run of equal values as ``block``."""
    last, n = None, 0
    for batch in batches:
        if batch.num_rows:
            shared = batch.column("shared")
            new = np.ones(batch.num_rows, bool)
            new[0] = last is None or shared[0].as_py() != last
            if batch.num_rows > 1:
                new[1:] = pc.not_equal(shared.slice(1), shared.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            block = n + np.cumsum(new)
            last, n = shared[-1].as_py(), int(block[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "n", "m", "lo", "hi", "middle")), pa.array(block)], names=["word", "n", "m", "lo", "hi", "middle", "block"])


def vocabulary(words: DataFrame, word: str, least_chars: int = 7, least_count: int = 2) -> DataFrame:
    """``(word, n)`` of the words in a column that are long and frequent enough; nulls are none."""
    long = words.where(F.length(word) >= least_chars)
    return long.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def variants(words: DataFrame, ratio: int = 10, block_words: int = 4096) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each of ``words(word, n)``, distinct words with their counts.

    Near words differ by exactly one inserted, deleted or replaced code point.  A word's form is its most frequent near
    word (ties: the first in code-point order), if that is at least ``ratio`` times as frequent, else null; its root is
    the last word that forms lead to, or the word itself.  Null and empty words are left out.
    """
    stash = Stash(words.sparkSession, "spelling")
    words = stash.put(words.where("word is not null and word <> ''").select("word", F.col("n").cast("long").alias("n")))
    found = near_words(words, stash, block_words)
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("minus_n"), F.lit(None).cast("string").alias("best"))
    both = own.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    top = F.when(F.col("best").isNotNull(), F.struct("minus_n", "best"))
    met = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min(top).alias("top"))
    is_form = -F.col("top.minus_n") >= F.col("n") * ratio
    met = stash.put(met.select("word", "n", "n_near", F.when(is_form, F.col("top.best")).alias("form"), F.when(is_form, -F.col("top.minus_n")).alias("form_n")))
    up = stash.put(met.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # counts grow along forms, so no way is a ring; each round doubles its length
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = stash.put(up.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        up = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return met.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
