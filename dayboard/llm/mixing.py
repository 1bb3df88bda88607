"""Rates that mix documents to target weights of soft domains.

A classifier fitted on a labelled table gives every document a posterior over domains.  The rates r >= 0 (expected
copies of each document) are fitted by projected gradient descent on the squares of
``sum(r * tokens * posterior) - target tokens`` over all documents.  The state of a document is replayed from the
short list of gradients, so a step is one pass over a narrow table that sends one number per domain to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .linear import DIM, fit_softmax, posterior, word_features
from .sampling import labelled_texts
from .storage import Stash


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return posterior(at, value, self.weights, self.bias)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        got = [word_features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([g[0].astype(np.int32).tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())], names=["label", "at", "value"])


def fit_domains(labels: DataFrame, docs: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text", *, per_domain: int = 1500) -> DomainModel:
    """Fit on the texts of about ``per_domain`` rows of each domain in ``labels``; null domains are left out.

    With no labelled rows there is a single domain ``all``.
    """
    got, counts = labelled_texts(labels, docs, domain_col, id_col, text_col, per_domain)
    got = got.mapInArrow(_features, "label string, at binary, value binary").collect()
    domains = sorted({r.label for r in got})
    if len(domains) < 2:
        return DomainModel(domains or ["all"], np.zeros((DIM + 1024, 1)), np.zeros(1))
    got.sort(key=lambda r: (r.label, bytes(r.at)))
    y = np.array([domains.index(r.label) for r in got])
    prior = np.array([counts[d] for d in domains], float)
    w, b = fit_softmax([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], float)) for r in got], y, len(domains), prior / prior.sum())
    return DomainModel(domains, w, b)


def _posteriors(batches: Iterator[pa.RecordBatch], model: DomainModel) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        tokens, p = [], []
        for text in batch.column("text").to_pylist():
            at, value, n = word_features(text or "")
            tokens.append(n), p.append(model.posterior(at, value).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tokens, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=["id", "tokens", "posterior"])


def _columns(batch: pa.RecordBatch, k: int, protect: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, posteriors and lowest rates of a batch."""
    p = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
    low = np.zeros(len(p)) if protect is None else (p[:, protect] >= 0.5).astype(float)
    return batch.column("tokens").to_numpy().astype(float), p, low


def _replay(p: np.ndarray, low: np.ndarray, steps: list[np.ndarray], most: float) -> np.ndarray:
    rate = np.ones(len(p))
    for step in steps:
        rate = np.clip(rate - p @ step, low, most)
    return rate


def _totals(batches: Iterator[pa.RecordBatch], k: int, steps: list[np.ndarray], most: float, protect: int | None) -> Iterator[pa.RecordBatch]:
    total, square = np.zeros(k), np.zeros((k, k))
    for batch in batches:
        tokens, p, low = _columns(batch, k, protect)
        total += (_replay(p, low, steps, most) * tokens) @ p
        if not steps:
            square += p.T @ (p * tokens[:, None])
    yield pa.RecordBatch.from_arrays([pa.array([[*total, *square.ravel()]], pa.list_(pa.float64()))], names=["sums"])


def _rates(batches: Iterator[pa.RecordBatch], k: int, steps: list[np.ndarray], most: float, protect: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, p, low = _columns(batch, k, protect)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tokens"), batch.column("posterior"), pa.array(_replay(p, low, steps, most))], names=["id", "tokens", "posterior", "rate"])


def fit_rates(docs: DataFrame, model: DomainModel, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", *, protected: str | None = None, most: float = float("inf"), budget: float | None = None, tolerance: float = 1e-6, max_steps: int = 40) -> DataFrame:
    """One row ``(id_col, tokens, posterior, rate)`` per input row; ``posterior`` follows ``model.domains``.

    Tokens are words.  Targets are weights of domains (missing ones 0), scaled to ``budget`` tokens, by default those
    the corpus has.  Rates are at most ``most``; documents that are of the ``protected`` domain rather than not keep
    a rate of 1 at least.  Targets that the corpus cannot reach are met as closely as squares allow.  Null and empty
    texts have no tokens and the posterior of a text without features; repeated rows get equal rates; an empty
    table gives no rows.  Other columns are not read.
    """
    stash = Stash(docs.sparkSession, "mixing")
    k = len(model.domains)
    protect = model.domains.index(protected) if protected in model.domains else None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    base = stash.put(rows.mapInArrow(lambda it: _posteriors(it, model), f"id {id_type}, tokens long, posterior array<double>"))

    def sums(steps: list[np.ndarray]) -> np.ndarray:
        parts = base.mapInArrow(lambda it: _totals(it, k, steps, most, protect), "sums array<double>")
        cells = parts.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(k + k * k)
        for c in cells:
            out[c.i] = c.x
        return out

    first = sums([])
    total, square = first[:k], first[k:].reshape(k, k)
    wish = np.array([max(0.0, targets.get(d, 0.0)) for d in model.domains])
    steps: list[np.ndarray] = []
    if total.sum() > 0 and wish.sum() > 0:
        goal = wish / wish.sum() * (budget if budget is not None else total.sum())
        inverse = np.linalg.pinv(square, rcond=1e-10, hermitian=True)
        last = None
        for _ in range(max_steps):
            off = total - goal
            size = float(off @ inverse @ off)
            # squares in the metric of the corpus's own second moments, in which a full step never overshoots
            if np.abs(off).max() <= tolerance * goal.sum() or last is not None and last - size <= 1e-9 * last:
                break
            last = size
            steps.append(inverse @ off)
            total = sums(steps)[:k]
    return base.mapInArrow(lambda it: _rates(it, k, steps, most, protect), f"id {id_type}, tokens long, posterior array<double>, rate double").withColumnRenamed("id", id_col)
