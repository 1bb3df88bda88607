"""Language identification in two steps: the family first, then one-versus-one machines inside the family.

A text is its hashed character 1- to 3-grams (letters in lower case; whatever else is one space), as square roots
of counts, scaled to unit length.  One linear support vector machine per family tells it from the others; inside
a family, one per pair of languages votes.  Only this second step has to tell closely related languages apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .sampling import labelled_sample
from .storage import small_batches

DIM = 1 << 12
_BLOCK = 1 << 20
UNDETERMINED = "und"

#: Language families by ISO 639-1 code.  A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "gu", "pa", "ne", "si"],
    "iranian": ["fa", "ps", "ku", "tg"],
    "semitic": ["ar", "he", "mt", "am"],
    "dravidian": ["ta", "te", "kn", "ml"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def char_features(text: str) -> np.ndarray | None:
    """Unit vector of a whole text, None if it has no letter.  Long texts are counted in blocks."""
    c = T.codes(text)
    counts = np.zeros(DIM)
    seen = False
    for at in range(0, len(c), _BLOCK):
        part = c[max(0, at - 2) : at + _BLOCK]
        letter = T.letter_table()[part]
        seen = seen or bool(letter.any())
        low = np.where(letter, T.lower_table()[part], np.uint32(32))
        if len(low) > 1:
            low = low[np.concatenate([[True], (low[1:] != 32) | (low[:-1] != 32)])]
        one = low * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(31) + low[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(131) + low[2:] * np.uint32(0xC2B2AE3D)
        for h in (one, two, three):
            h = h ^ (h >> np.uint32(15))
            counts += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=DIM)
    if not seen:
        return None
    out = np.sqrt(counts)
    return out / np.linalg.norm(out)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 120) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss; y is +-1; classes weigh alike."""
    cost = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1)) * 100 * c
    w = v = np.zeros(x.shape[1] + 1)
    fit = lambda w: (x @ w[:-1].astype(x.dtype)).astype(float) + w[-1]
    step = 1 / (1 + 4 * cost.sum())  # |x| is 1, the bias adds 1
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * fit(v)) * y * cost
        grad = v - 2 * np.append((slack.astype(x.dtype) @ x).astype(float), slack.sum())
        new, after = v - step * grad, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    return w


def fit_slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Steepness of the logistic curve that turns margins into probabilities."""
    grid = np.geomspace(0.5, 8, 17)
    return float(grid[np.argmin([np.logaddexp(0, -y * margin * a).mean() for a in grid])])


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIM + 1, 0)))
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: dict[str, list[tuple[int, int, int]]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = char_features(text) if text else None
        if x is None or not self.families:
            return UNDETERMINED, 0.0
        p = 1 / (1 + np.exp(-np.clip((x @ self.weights[:-1] + self.weights[-1]) * self.slopes, -60, 60)))
        if len(self.families) == 1:
            family, score = self.families[0], 1.0
        else:
            each = p[: len(self.families)]
            best = int(np.argmax(each))
            family, score = self.families[best], float(each[best] / each.sum())
        langs = self.members[family]
        if len(langs) == 1:
            return langs[0], score
        votes = np.zeros(len(langs))
        mass = np.zeros(len(langs))
        for a, b, k in self.pairs[family]:
            votes[a if p[k] >= 0.5 else b] += 1
            mass[a] += p[k]
            mass[b] += 1 - p[k]
        best = max(range(len(langs)), key=lambda i: (votes[i], mass[i]))
        return langs[best], score * float(mass[best] / (len(langs) - 1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        label, out = [], []
        for lang, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            x = char_features(text)
            if x is not None:
                label.append(lang), out.append(x.astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(out, pa.binary())], names=["label", "x"])


def fit_language_model(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, *, per_language: int = 500, families: dict[str, str] | None = None) -> LanguageModel:
    """Fit on about ``per_language`` rows of each language, as feature vectors of 8 kB each."""
    families = FAMILY_OF if families is None else families
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label")).where("text is not null and label is not null")
    sample, _ = labelled_sample(rows, "label", "id", per_language)
    got = sample.mapInArrow(_features, "label string, x binary").collect()
    model = LanguageModel()
    if not got:
        return model
    x = np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32)
    lang = np.array([r.label for r in got])
    del got
    family = np.array([families.get(v, v) for v in lang])
    model.families = sorted(set(family))
    columns, slopes = [], []

    def add(rows: np.ndarray, y: np.ndarray) -> int:
        w = fit_svm(x[rows], y)
        columns.append(w)
        slopes.append(fit_slope(x[rows] @ w[:-1] + w[-1], y))
        return len(columns) - 1

    for name in model.families:
        model.members[name] = sorted(set(lang[family == name]))
        if len(model.families) > 1:
            add(np.arange(len(lang)), np.where(family == name, 1.0, -1.0))
    for name in model.families:
        model.pairs[name] = []
        for a, b in combinations(range(len(model.members[name])), 2):
            first, second = model.members[name][a], model.members[name][b]
            rows = np.flatnonzero((lang == first) | (lang == second))
            model.pairs[name].append((a, b, add(rows, np.where(lang[rows] == first, 1.0, -1.0))))
    if columns:
        model.weights, model.slopes = np.array(columns).T, np.array(slopes)
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        got = [model.predict(t) for t in batch.column("_text").to_pylist()]
        at = batch.schema.get_field_index("_text")
        kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
        names = [n for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])


def identify(docs: DataFrame, text_col: str, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``, one row per input row.

    Null text and text without a letter give ``und`` with score 0, and so does every text if the model was
    fitted on no rows.  Whole texts are read, whatever their length; repeated rows give equal rows.  Kept columns of
    the results' names give way to them.
    """
    small_batches(docs.sparkSession)
    keep = [k for k in keep if k not in ("lang_pred", "score", "_text")]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"), "lang_pred string", "score double"])
    return rows.mapInArrow(lambda it: _predict(it, model), schema)


def held_out(id_col: str, parts: int, part: int):
    """True where the CRC of the id as text falls into one of so many parts; null ids count as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(True))
