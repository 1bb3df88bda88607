"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node.  Nodes start with neighbours from blocks of random projections; then each round joins
every node's neighbours and reverse neighbours with each other (a neighbour of a neighbour is likely one too) and
keeps the closest, until few lists change.  A search starts at the query's own neighbours and expands the nearest
nodes not yet expanded, a batch a round, until its beam holds no more of them.  Rounds use vectors in 16-bit integers
with a scale each, which tell apart what differs by a 30,000th of a vector's largest component; the whole beam is
then ranked by distances of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Stash

_GRAPH = "node long, code binary, ids binary, ds binary, new binary, n_new int"


def encode(x: np.ndarray) -> list[bytes]:
    """16-bit integers of each vector after its scale; vectors are not zero."""
    scale = (np.abs(x).max(axis=1, keepdims=True) / 32767).astype("<f4")
    body = np.clip(np.rint(x / np.maximum(scale, np.float32(1e-38))), -32768, 32767).astype("<i2")
    return [s.tobytes() + b.tobytes() for s, b in zip(scale, body, strict=True)]


def decode(codes: list[bytes] | bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(codes if isinstance(codes, bytes) else b"".join(codes), np.uint8).reshape(n, -1)
    return raw[:, 4:].copy().view("<i2") * raw[:, :4].copy().view("<f4").astype(float)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def nearest(ids: np.ndarray, ds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest distinct ids, nearest first, ties to smaller ids."""
    order = np.lexsort((ids, ds))
    ids, ds = ids[order], ds[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], ds[first]


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by ``key``, and where each group starts."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        k = rest.column(key).to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        if len(cut):
            yield rest.slice(0, cut[-1]), np.concatenate([[0], cut[:-1]])
            rest = rest.slice(cut[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0])


def _nodes(batches: Iterator[pa.RecordBatch], dim: int, projections: int) -> Iterator[pa.RecordBatch]:
    line = np.random.default_rng(11).standard_normal((dim, projections))
    for batch in batches:
        if batch.num_rows:
            x = batch.column("vec").flatten().to_numpy().reshape(-1, dim)
            unit = x / np.abs(x).max(axis=1, keepdims=True)
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(encode(x), pa.binary()), *(pa.array(p) for p in (unit @ line).T)], names=["node", "code", *(f"p{i}" for i in range(projections))])


def _blocks(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """Nearest neighbours inside blocks of consecutive rows."""
    rest: list[pa.RecordBatch] = []

    def join(t: pa.Table) -> pa.RecordBatch:
        node, x = t.column("node").to_numpy(), decode(t.column("code").to_pylist(), t.num_rows)
        d = squared(x, x)
        np.fill_diagonal(d, np.inf)
        m = min(k, len(node) - 1)
        at = np.argpartition(d, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(node), 0), int)
        ids, ds = node[at], np.take_along_axis(d, at, 1).astype("<f4")
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array([r.tobytes() for r in ids], pa.binary()), pa.array([r.tobytes() for r in ds], pa.binary())], names=["node", "ids", "ds"])

    have = 0
    for batch in batches:
        rest.append(batch)
        have += batch.num_rows
        while have >= 2 * size:
            t = pa.Table.from_batches(rest).combine_chunks()
            yield join(t.slice(0, size))
            rest, have = t.slice(size).to_batches(), have - size
    if have:
        t = pa.Table.from_batches(rest).combine_chunks()
        for a in range(0, have, size):
            # the last block takes rows of the one before it, so that it is not too small
            first = max(0, min(a, have - size))
            yield join(t.slice(first, size))


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Lists so far (may be null) and found lists -> the nearest of both; what was not listed before is new."""
    for batch in batches:
        out = []
        for ids, ds, found in zip(batch.column("ids").to_pylist(), batch.column("ds").to_pylist(), batch.column("found").to_pylist(), strict=True):
            old, old_d = np.frombuffer(ids or b"", "<i8"), np.frombuffer(ds or b"", "<f4")
            got = [np.frombuffer(f["ids"], "<i8") for f in found or []]
            got_d = [np.frombuffer(f["ds"], "<f4") for f in found or []]
            new_ids, new_ds = nearest(np.concatenate([old, *got]), np.concatenate([old_d, *got_d]), k)
            fresh = ~np.isin(new_ids, old)
            out.append((new_ids.tobytes(), new_ds.tobytes(), fresh.astype(np.uint8).tobytes(), int(fresh.sum())))
        cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), *(pa.array(c, pa.binary()) for c in cols[:3]), pa.array(cols[3], pa.int32())], names=["node", "code", "ids", "ds", "new", "n_new"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = batch.column("node").to_numpy()
        ids = [np.frombuffer(x, "<i8") for x in batch.column("ids").to_pylist()]
        new = [np.frombuffer(x, np.uint8) for x in batch.column("new").to_pylist()]
        if len(node):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, [len(x) for x in ids])), pa.array(np.concatenate(ids)), pa.array(np.concatenate(new).astype(np.int8))], names=["u", "v", "new"])


def _local_join(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """For each member of a group, the closest others of it that would improve its list; old pairs have met before."""
    for t, starts in groups(batches, "u"):
        v, new, worst = t.column("v").to_numpy(), t.column("new").to_numpy() > 0, t.column("worst").to_numpy()
        x = decode(t.column("code").to_pylist(), t.num_rows)
        node, ids, ds = [], [], []
        for a, b in zip(starts, [*starts[1:], t.num_rows], strict=True):
            if b - a < 2:
                continue
            d = squared(x[a:b], x[a:b])
            d[~(new[a:b, None] | new[None, a:b]) | (d >= worst[a:b, None])] = np.inf
            np.fill_diagonal(d, np.inf)
            if b - a > most:
                at = np.argpartition(d, most, axis=1)[:, :most]
            else:
                at = np.broadcast_to(np.arange(b - a), (b - a, b - a))
            close = np.take_along_axis(d, at, 1)
            for i in np.flatnonzero(np.isfinite(close).any(axis=1)):
                ok = np.isfinite(close[i])
                node.append(v[a + i]), ids.append(v[a + at[i][ok]].tobytes()), ds.append(close[i][ok].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(ids, pa.binary()), pa.array(ds, pa.binary())], names=["node", "ids", "ds"])


def _adjacency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, starts in groups(batches, "u"):
        u, v, code = t.column("u").to_numpy(), t.column("v").to_numpy(), t.column("code").to_pylist()
        spans = list(zip(starts, [*starts[1:], t.num_rows], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(u[starts]), pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([b"".join(code[a:b]) for a, b in spans], pa.binary())], names=["node", "near", "codes"])


class NeighbourGraph:
    """NN-descent over ``nodes(node long, vec array<double>)``: distinct vectors, finite and not zero, of one length."""

    def __init__(self, nodes: DataFrame, dim: int, stash: Stash, *, k: int = 40, block: int = 1024, projections: int = 3, found_per_group: int = 12, enough: float = 0.02):
        self.stash, self.k = stash, k
        cols = ", ".join(f"p{i} double" for i in range(projections))
        base = stash.put(nodes.mapInArrow(lambda it: _nodes(it, dim, projections), f"node long, code binary, {cols}"))
        lists = None
        for i in range(projections):
            near = base.select("node", "code", f"p{i}").orderBy(f"p{i}", "node").mapInArrow(lambda it: _blocks(it, k, block), "node long, ids binary, ds binary")
            lists = near if lists is None else lists.unionByName(near)
        found = lists.groupBy("node").agg(F.collect_list(F.struct("ids", "ds")).alias("found"))
        start = base.select("node", "code").join(found, "node", "left").withColumns({"ids": F.lit(None).cast("binary"), "ds": F.lit(None).cast("binary")})
        graph = stash.put(start.mapInArrow(lambda it: _merge(it, k), _GRAPH))
        n = graph.count()
        stash.drop(base)
        fresh = n * k if n > block else 0
        while fresh > enough * n * k:  # lists only get nearer, so this ends
            after = stash.put(self._round(graph, found_per_group))
            stash.drop(graph)
            graph = after
            fresh = graph.agg(F.sum("n_new")).first()[0] or 0
        self.graph = graph

    def _pairs(self, graph: DataFrame) -> DataFrame:
        """Each node with its neighbours and up to k nodes, drawn by hash, of those whose neighbour it is."""
        edges = graph.mapInArrow(_edges, "u long, v long, new byte")
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "new")
        drawn = back.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v"), "v"))).where(F.col("r") <= self.k).drop("r")
        return edges.unionByName(drawn).groupBy("u", "v").agg(F.max("new").alias("new"))

    def _round(self, graph: DataFrame, most: int) -> DataFrame:
        k = self.k
        last = graph.select(F.col("node").alias("v"), "code", "ds").mapInArrow(lambda it: _worst(it, k), "v long, code binary, worst float")
        joined = self._pairs(graph).join(last, "v").repartition("u").sortWithinPartitions("u")
        found = joined.mapInArrow(lambda it: _local_join(it, most), "node long, ids binary, ds binary")
        met = found.groupBy("node").agg(F.collect_list(F.struct("ids", "ds")).alias("found"))
        return graph.select("node", "code", "ids", "ds").join(met, "node", "left").mapInArrow(lambda it: _merge(it, k), _GRAPH)

    def adjacency(self) -> DataFrame:
        """``(node, near, codes)``: neighbours both ways, with their vectors in bytes."""
        code = self.graph.select(F.col("node").alias("v"), "code")
        rows = self._pairs(self.graph).join(code, "v").select("u", "v", "code").repartition("u").sortWithinPartitions("u")
        return self.stash.put(rows.mapInArrow(_adjacency, "node long, near binary, codes binary"))


def _worst(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ds = [np.frombuffer(x, "<f4") for x in batch.column("ds").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("code"), pa.array([float(d[-1]) if len(d) == k else np.inf for d in ds], pa.float32())], names=["v", "code", "worst"])


def _frontier(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The nearest nodes of each beam that are not expanded yet."""
    for batch in batches:
        q, code, node = [], [], []
        for i, c, ids, done in zip(*(batch.column(n).to_pylist() for n in ("q", "code", "ids", "done")), strict=True):
            x = np.frombuffer(ids, "<i8")[np.frombuffer(done, np.uint8) == 0][:width]
            q += [i] * len(x)
            code += [c] * len(x)
            node += x.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(code, pa.binary()), pa.array(node, pa.int64())], names=["q", "code", "node"])


def _expand(batches: Iterator[pa.RecordBatch], beam: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ds = [], []
        for code, near, codes in zip(*(batch.column(n).to_pylist() for n in ("code", "near", "codes")), strict=True):
            v = np.frombuffer(near, "<i8")
            d = squared(decode([code], 1), decode(codes, len(v)))[0]
            i, e = nearest(v, d, beam)
            ids.append(i.tobytes()), ds.append(e.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), pa.array(ids, pa.binary()), pa.array(ds, pa.binary())], names=["q", "node", "ids", "ds"])


def _advance(batches: Iterator[pa.RecordBatch], beam: int, width: int) -> Iterator[pa.RecordBatch]:
    """Mark what was expanded and take in what was found; a query itself is never in its beam."""
    for batch in batches:
        out = []
        for q, ids, ds, done, found in zip(*(batch.column(n).to_pylist() for n in ("q", "ids", "ds", "done", "found")), strict=True):
            x, d, seen = np.frombuffer(ids, "<i8"), np.frombuffer(ds, "<f4"), np.frombuffer(done, np.uint8)
            expanded = np.concatenate([x[seen == 1], x[seen == 0][:width]])
            got = [np.frombuffer(f["ids"], "<i8") for f in found or []]
            got_d = [np.frombuffer(f["ds"], "<f4") for f in found or []]
            y, e = np.concatenate([x, *got]), np.concatenate([d, *got_d])
            y, e = nearest(y[y != q], e[y != q], beam)
            flag = np.isin(y, expanded).astype(np.uint8)
            out.append((y.tobytes(), e.tobytes(), flag.tobytes(), int((flag == 0).sum())))
        cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("code"), *(pa.array(c, pa.binary()) for c in cols[:3]), pa.array(cols[3], pa.int32())], names=["q", "code", "ids", "ds", "done", "open"])


def _beam_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q, ids = batch.column("q").to_numpy(), [np.frombuffer(x, "<i8") for x in batch.column("ids").to_pylist()]
        # a query's own node is near it too: its equals are candidates
        ids = [np.append(x, i) for i, x in zip(q, ids, strict=True)]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, [len(x) for x in ids])), pa.array(np.concatenate(ids))], names=["q", "node"])


def greedy_search(graph: NeighbourGraph, asked: DataFrame, *, beam: int = 300, width: int = 64) -> DataFrame:
    """``asked(q)`` nodes -> ``(q, node)``: the nodes of each query's beam, and itself."""
    stash = graph.stash
    near = graph.adjacency()
    mine = graph.graph.join(asked.select(F.col("q").alias("node")), "node", "left_semi")
    zeros = F.unhex(F.repeat(F.lit("00"), (F.length("ids") / 8).cast("int")))
    state = stash.put(mine.select(F.col("node").alias("q"), "code", "ids", "ds", zeros.alias("done"), (F.length("ids") / 8).cast("int").alias("open")))
    schema = "q long, code binary, ids binary, ds binary, done binary, open int"
    while not state.where("open > 0").isEmpty():
        front = stash.put(state.where("open > 0").mapInArrow(lambda it: _frontier(it, width), "q long, code binary, node long"))
        found = near.join(front, "node").mapInArrow(lambda it: _expand(it, beam), "q long, node long, ids binary, ds binary")
        met = found.groupBy("q").agg(F.collect_list(F.struct("ids", "ds")).alias("found"))
        after = stash.put(state.join(met, "q", "left").mapInArrow(lambda it: _advance(it, beam, width), schema))
        stash.drop(state), stash.drop(front)
        state = after
    return state.mapInArrow(_beam_nodes, "q long, node long")


def search(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, *, top: int = 10, **graph_options) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``top`` nearest other rows of each query id, by Euclidean distance.

    Null, zero and non-finite vectors, those with null components, and those of another length than most rows take
    no part, nor do null ids.  Equal vectors are found together; ties go to the smaller id.  Rows that repeat an
    id are one row.  Fewer than two rows give no result.
    """
    stash = Stash(vectors.sparkSession, "ann")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(finite)
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths["dim"]
    rows = rows.where(F.size("vec") == dim)
    nodes = stash.put(rows.groupBy("vec").agg(F.min("id").alias("node")))
    members = stash.put(rows.join(nodes, "vec").select("id", "node").distinct())
    graph = NeighbourGraph(nodes, dim, stash, **graph_options)
    wanted = members.join(queries.select(F.col(queries.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi")
    found = greedy_search(graph, wanted.select(F.col("node").alias("q")).distinct())
    vec = lambda n, v: nodes.select(F.col("node").alias(n), F.col("vec").alias(v))
    apart = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    exact = found.join(vec("q", "a"), "q").join(vec("node", "b"), "node").select("q", "node", apart.alias("score"))
    # of equal vectors, the smallest ids are all that can be among the nearest
    low = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= top + 1).drop("r")
    by_q = Window.partitionBy("q").orderBy("score", "id")
    near = exact.join(low, "node").withColumn("r", F.row_number().over(by_q)).where(F.col("r") <= top + 1).select("q", F.col("id").alias("vec_id"), "score")
    pairs = wanted.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(near, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
