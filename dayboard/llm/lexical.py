"""Ranked lexical search of many queries at once, sharing what they have in common.

Terms of all queries that stand in the same queries are one base node.  Pairs of nodes that several queries share
are replaced by a node of their own, the most shared first, until no pair is shared: a graph of partial sums in
which each query is the sum of a few nodes.  Documents are scanned twice.  The first scan counts the queries' terms
and all terms of every document; the counts are written once and give the statistics of the corpus.  The second
turns counts into weighted contributions, sums them into the accumulators of the base nodes, adds up the shared
nodes level by level, each once for all queries above it, and reads the queries' scores off.  A task keeps the best
documents of each query; theirs are ranked by Spark.

Queries are taken in blocks of a bounded number of terms, so what a task or the driver holds does not grow with the
number of queries.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .storage import Stash

#: Other ASCII than letters and digits separates terms; all other code points belong to them.  A-Z become a-z.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(utf8: bytes | None) -> list[bytes]:
    """The terms of a text in order; null has none."""
    return (utf8 or b"").translate(_FOLD).split()


@dataclass
class Plan:
    """Which nodes add up to which queries.  Node k below ``len(base)`` sums terms, a later one two earlier nodes."""

    node_of_term: np.ndarray
    n_base: int
    pairs: np.ndarray  # (nodes above the base, 2)
    level: np.ndarray  # of those
    nodes: np.ndarray  # of all queries, one after the other
    first: np.ndarray  # where each query's begin

    @property
    def n_nodes(self) -> int:
        return self.n_base + len(self.pairs)


def share(queries: list[list[int]], n_terms: int, window: int = 64) -> Plan:
    """A plan for queries given as lists of distinct terms, none empty.

    Nodes of a query are ordered by how many queries have them, and pairs are sought among ``window`` of them at a
    time, so that a query of very many terms costs no more than in proportion.
    """
    holders: list[list[int]] = [[] for _ in range(n_terms)]
    for q, ts in enumerate(queries):
        for t in ts:
            holders[t].append(q)
    known: dict[tuple, int] = {}
    node_of_term = np.array([known.setdefault(tuple(h), len(known)) for h in holders], np.int64)
    users = [set(k) for k in known]
    mine: list[set[int]] = [set() for _ in queries]
    for node, qs in enumerate(users):
        for q in qs:
            mine[q].add(node)
    room: list[dict[int, int]] = []  # the window that a query's node lies in
    both: dict[tuple[int, int], set[int]] = defaultdict(set)
    for q, nodes in enumerate(mine):
        shared = sorted((n for n in nodes if len(users[n]) > 1), key=lambda n: (-len(users[n]), n))
        room.append({n: i // window for i, n in enumerate(shared)})
        for at in range(0, len(shared), window):
            for a, b in combinations(sorted(shared[at : at + window]), 2):
                both[a, b].add(q)
    heap = [(-len(qs), p) for p, qs in both.items() if len(qs) > 1]
    heapq.heapify(heap)
    pairs, level = [], [0] * len(users)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        qs = both.get((a, b), set())
        if len(qs) < 2:
            continue
        if len(qs) != -n:  # it has lost queries since
            heapq.heappush(heap, (-len(qs), (a, b)))
            continue
        new = len(level)
        pairs.append((a, b)), level.append(1 + max(level[a], level[b]))
        fresh: dict[tuple[int, int], set[int]] = defaultdict(set)
        for q in list(qs):
            near = room[q][a]
            for old in (a, b):
                mine[q].discard(old)
                del room[q][old]
            for other, r in room[q].items():
                if r == near:
                    for old in (a, b):
                        both[min(old, other), max(old, other)].discard(q)
                    fresh[other, new].add(q)
            mine[q].add(new)
            room[q][new] = near
        del both[a, b]
        for p, users_of in fresh.items():
            if len(users_of) > 1:
                both[p] = users_of
                heapq.heappush(heap, (-len(users_of), p))
    size = [len(m) for m in mine]
    flat = np.array([n for m in mine for n in sorted(m)], np.int64)
    return Plan(node_of_term, len(known), np.array(pairs, np.int64).reshape(-1, 2), np.array(level[len(known) :], np.int64), flat, np.cumsum([0, *size[:-1]]))


def scores(plan: Plan, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """``(queries, documents)``: sums of the values of each query's terms, in 64-bit integers."""
    acc = np.zeros((plan.n_nodes, n_docs), np.int64)
    if len(doc):
        cell = plan.node_of_term[term] * n_docs + doc
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        acc.ravel()[cell[start]] = np.add.reduceat(value[order], start)
    for n in range(1, int(plan.level.max(initial=0)) + 1):
        at = np.flatnonzero(plan.level == n)
        acc[plan.n_base + at] = acc[plan.pairs[at, 0]] + acc[plan.pairs[at, 1]]
    return np.add.reduceat(acc[plan.nodes], plan.first, axis=0)


def _count(batches: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """How many terms each text has, and how often each known one; texts without a term give no row."""
    for batch in T.slices(batches):
        rows, n, off, code, often = [], [], [0], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            found = terms(text)
            if found:
                t, c = np.unique(np.fromiter((known[x] for x in found if x in known), np.int32), return_counts=True)
                rows.append(i), n.append(len(found)), off.append(off[-1] + len(t)), code.append(t), often.append(c)
        off = pa.array(off, pa.int32())
        code, often = (np.concatenate(x) if x else np.empty(0) for x in (code, often))
        out = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(off, pa.array(code.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(often.astype(np.int64)))]
        yield pa.RecordBatch.from_arrays(out, names=["id", "n", "terms", "tf"])


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class _Best:
    """The best documents of each query so far: by score, then id, those without an id last."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.least = k, np.ones(n_queries, np.int64)
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.none = np.empty(0, bool)

    def add(self, found: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        q, d = np.nonzero(found >= self.least[:, None])
        query, score, id_, none = (np.concatenate(x) for x in ((self.query, q), (self.score, found[q, d]), (self.id, ids[d]), (self.none, none[d])))
        order = np.lexsort((id_, none, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[rank < self.k]
        self.query, self.score, self.id, self.none = query[rank < self.k], score[order], id_[order], none[order]
        last = rank[rank < self.k] == self.k - 1
        self.least[self.query[last]] = self.score[last]


def _search(batches: Iterator[pa.RecordBatch], plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int, cells: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    best = _Best(k, len(plan.first))
    step = max(1, cells // (plan.n_nodes + len(plan.nodes)))
    for batch in T.slices(batches, step):
        m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], np.int64)
        lists, tf = batch.column("terms"), batch.column("tf").flatten().to_numpy()
        doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        term = lists.flatten().to_numpy()
        value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        ids = batch.column("id")
        best.add(scores(plan, doc, term, value, batch.num_rows), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
    out = [pa.array(best.query), pa.array(best.id, mask=best.none), pa.array(best.score)]
    yield pa.RecordBatch.from_arrays(out, names=["query", "id", "score"])


def _best_rows(rows: DataFrame, k: int, *groups: str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        found = [sorted(set(terms(t))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.binary()))], names=["id", "terms"])


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = 100_000) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of highest score above 0 for each item, equal scores by
    ascending id.

    An item's rows are one query with the terms of all of them (those without an id too); one without a term, or whose
    terms no document has, gives no row.  Rows that repeat a document's id are documents of their own, those without
    an id come after others of their score; null and empty texts have no term.  Other columns are not read, whatever
    their names.  Blocks hold about ``block_terms`` terms, or one item that has more.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "lexical")
    asked = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).mapInArrow(_terms_of, "id long, terms array<binary>")
    asked = asked.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)
    asked = stash.put(asked)
    blocks = ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text"))
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()  # bounded by block_terms
        if block:
            found = _search_block(stash, texts, [(r.id, r.terms) for r in block], k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"{item_id} long, rank int, {doc_id} long, score long")
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")


def _search_block(stash: Stash, texts: DataFrame, block: list[tuple], k: int) -> DataFrame:
    known: dict[bytes, int] = {}
    queries = [[known.setdefault(bytes(t), len(known)) for t in ts] for _, ts in block]
    counted = stash.put(texts.mapInArrow(lambda it: _count(it, known), "id long, n long, terms array<int>, tf array<long>"))
    n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
    df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # one row a term of the block
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(known))], np.int64)
    plan = share(queries, len(known))
    best = counted.where(F.size("terms") > 0).mapInArrow(lambda it: _search(it, plan, weights, n_docs, n_terms, k), "query long, id long, score long")
    best = _best_rows(best.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32))), k, "query", "part")
    names = stash.spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "query long, item long")
    return _best_rows(best.drop("rank", "part"), k, "query").join(names, "query").select("item", "rank", "id", "score")
