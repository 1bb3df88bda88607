"""Sparse bags of hashed words and a softmax classifier on them, for texts inside Arrow batches."""

from __future__ import annotations

import numpy as np

from . import textops as T

DIM = 1 << 14
_SIGNS = 1 << 10


def word_features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature numbers, values (unit length) and the number of words of a whole text.

    Features are words and, in a range of their own, the signs between them.
    """
    c = T.codes(text)
    h, _, _ = T.words(c)
    sign = c[~T.word_table()[c] & (c > 32)]
    n = np.bincount((h >> np.uint64(50)).astype(np.int64), minlength=DIM)
    m = np.bincount((sign * np.uint32(0x9E3779B1)) >> np.uint32(22), minlength=_SIGNS)
    both = np.concatenate([n, m])
    at = np.flatnonzero(both)
    value = np.sqrt(both[at])
    return at, value / max(np.linalg.norm(value), 1e-12), len(h)


def fit_softmax(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, prior: np.ndarray, *, ridge: float = 1e-4, steps: int = 150, scale: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and biases; ``prior`` holds the classes' shares in the whole table."""
    dim = DIM + _SIGNS
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows]) * scale
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = np.bincount(y, minlength=n_classes) / len(y)
    weight = (1 / np.maximum(share, 1e-9) / n_classes)[y] / len(y)  # classes weigh alike
    hot = np.eye(n_classes)[y]
    w, b = np.zeros((dim, n_classes)), np.zeros(n_classes)
    m1, m2 = np.zeros((dim + 1, n_classes)), np.zeros((dim + 1, n_classes))
    for t in range(1, steps + 1):
        z = np.stack([np.bincount(row, value * w[at, k], len(rows)) for k in range(n_classes)], 1) + b
        z = np.exp(z - z.max(1, keepdims=True))
        err = (z / z.sum(1, keepdims=True) - hot) * weight[:, None]
        g = np.stack([np.bincount(at, value * err[row, k], dim) for k in range(n_classes)], 1) + ridge * w
        g = np.vstack([g, err.sum(0)])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w * scale, b + np.log(np.maximum(prior, 1e-9) * n_classes)


def posterior(at: np.ndarray, value: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = value @ w[at] + b
    z = np.exp(z - z.max())
    return z / z.sum()
