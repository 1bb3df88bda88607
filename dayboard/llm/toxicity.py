"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

The score of a sentence is logistic in its distinct words; a document is toxic if any of its sentences is, so its
score is the noisy-or ``1 - prod(1 - sentence)``.  Only documents carry labels; the likelihood of these labels
under the noisy-or trains the weights of words, and the sentences that carry the score are the offending ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .sampling import labelled_texts
from .storage import small_batches

DIM = 1 << 18
#: Signs that end a sentence.
_ENDS = np.array([ord(c) for c in ".!?\n。！？"], np.uint32)


def sentence_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct words of each sentence, the sentence of each, and where each sentence starts.

    The start array has one entry more, the end of the text.  Sentences are numbered in order, those without a
    word too.
    """
    c = T.codes(text)
    h, start, _ = T.words(c)
    ends = np.flatnonzero(np.isin(c, _ENDS)) + 1
    bounds = np.unique(np.concatenate([[0], ends, [len(c)]]))
    sentence = np.searchsorted(bounds, start, side="right") - 1
    key = np.unique((sentence.astype(np.int64) << 18) | (h >> np.uint64(46)).astype(np.int64))
    return (key & (DIM - 1)).astype(np.int32), (key >> 18).astype(np.int32), bounds


@dataclass
class ToxicityModel:
    bias: float = -np.inf
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float32))

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Score of every sentence, and the bounds of the sentences; a sentence without a word scores 0."""
        word, sentence, bounds = sentence_words(text)
        n = len(bounds) - 1
        z = np.bincount(sentence, self.weights[word], n) + self.bias
        score = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        return np.where(np.bincount(sentence, minlength=n) > 0, score, 0.0), bounds


def noisy_or(scores: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum()))


def fit_noisy_or(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray | None = None, *, l1: float = 1e-4, steps: int = 300, min_docs: int = 4) -> ToxicityModel:
    """Proximal Adam on the likelihood of document labels; ``weight`` makes up for how documents were drawn."""
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / weight.sum()
    word = np.concatenate([d[0] for d in docs])
    n_sent = np.array([int(d[1][-1]) + 1 if len(d[1]) else 1 for d in docs])
    offset = np.cumsum(n_sent) - n_sent
    sent = np.concatenate([d[1] + o for d, o in zip(docs, offset, strict=True)])
    owner = np.repeat(np.arange(len(docs)), n_sent)
    of_doc = owner[sent]
    seen = np.unique(of_doc.astype(np.int64) * DIM + word)
    n_docs = np.bincount(seen % DIM, minlength=DIM)
    n_pos = np.bincount(seen % DIM, y[seen // DIM], minlength=DIM)
    del of_doc, seen
    use = n_docs >= min_docs
    vocab = np.flatnonzero(use)
    if not len(vocab):
        return ToxicityModel(bias=float(np.log(max(y.mean(), 1e-9) / max(1 - y.mean(), 1e-9))))
    number = np.full(DIM, -1)
    number[vocab] = np.arange(len(vocab))
    keep = use[word]
    word, sent = number[word[keep]], sent[keep]
    odds = np.log((n_pos + 0.5) / (y.sum() + 1)) - np.log((n_docs - n_pos + 0.5) / (len(y) - y.sum() + 1))
    w = np.clip(odds[vocab], 0, 3) * (odds[vocab] > 1)
    b, total = -5.0, int(n_sent.sum())
    has = np.bincount(sent, minlength=total) > 0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        s = np.where(has, 1 / (1 + np.exp(-np.clip(np.bincount(sent, w[word], total) + b, -30, 30))), 0.0)
        log_none = np.bincount(owner, np.log1p(-np.minimum(s, 1 - 1e-9)), len(docs))
        none = np.exp(log_none)
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-6), 1.0) * weight
        g_sent = pull[owner] * s
        g = np.append(np.bincount(word, g_sent[sent], len(w)), g_sent.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        rate = 0.1 / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-6)
        new = np.append(w, b) - rate * m1 / (1 - 0.9**t)
        w, b = new[:-1], min(float(new[-1]), -1.0)
        w = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(rate[:-1] * l1, 0.2))
    out = np.zeros(DIM, np.float32)
    out[vocab] = w
    return ToxicityModel(bias=b, weights=out)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        got = [sentence_words(t)[:2] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())], names=["label", "word", "sentence"])


def fit_toxicity(labels: DataFrame, docs: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", *, per_class: int = 2500) -> ToxicityModel:
    """Fit on the texts of about ``per_class`` documents of each label (0 and 1); null labels are left out.

    Without documents of both labels the score is the same for all: 0, or 1 if every label is 1.
    """
    rows = labels.where(F.col(label_col).isin(0, 1))
    sample, counts = labelled_texts(rows, docs, label_col, id_col, text_col, per_class)
    if len(counts) < 2:
        return ToxicityModel(bias=np.inf if "1" in counts else -np.inf)
    got = sample.mapInArrow(_features, "label string, word binary, sentence binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.word)))
    y = np.array([int(r.label) for r in got])
    drawn = np.bincount(y, minlength=2)
    weight = np.array([counts.get(str(k), 0) / max(drawn[k], 1) for k in (0, 1)])[y]
    bags = [(np.frombuffer(r.word, np.int32), np.frombuffer(r.sentence, np.int32)) for r in got]
    del got
    return fit_noisy_or(bags, y, weight)


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        score, starts, ends, values = [], [], [], []
        for text in batch.column("_text").to_pylist():
            if not text:
                score.append(0.0), starts.append([]), ends.append([]), values.append([])
                continue
            each, bounds = model.sentences(text)
            score.append(noisy_or(each))
            bad = np.flatnonzero(each >= 0.3)
            starts.append(bounds[bad].tolist()), ends.append(bounds[bad + 1].tolist()), values.append(each[bad].tolist())
        spans = pa.StructArray.from_arrays([pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["start", "end", "score"])
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(score, pa.float64()), spans], names=[*keep, "score", "offending"])


def score(docs: DataFrame, text_col: str, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``score`` of the whole text, and ``offending``: start, end and score of sentences at 0.3 or more.

    Null and empty texts and texts without a word score 0; repeated rows score alike; an empty table gives no rows.
    Kept columns of the results' names give way to them.
    """
    keep = [k for k in keep if k not in ("score", "offending", "_text")]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"), "score double, offending struct<start:array<int>,end:array<int>,score:array<double>>"])
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    return rows.mapInArrow(lambda it: _score(it, model.value, keep), schema)
