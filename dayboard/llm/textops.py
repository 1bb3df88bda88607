"""Vectorised text primitives used inside Arrow batches: code points, word hashes, mixing."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x100000001B3
_LIMIT = 0x110000


def mix(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    h = (h ^ (h >> U64(30))) * _M1
    h = (h ^ (h >> U64(27))) * _M2
    return h ^ (h >> U64(31))


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Lower case of each code point, where that is one code point."""
    out = np.arange(_LIMIT, dtype=np.uint32)
    for i in range(_LIMIT):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


@lru_cache(1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(_LIMIT)), bool, _LIMIT)


@lru_cache(1)
def word_table() -> np.ndarray:
    """Letters, digits and combining marks."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LNM" for i in range(_LIMIT)), bool, _LIMIT)


@lru_cache(1)
def _powers() -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[1], np.full(4095, _BASE)]).astype(U64))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that only so many rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # the worker lives on


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def words(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words among code points; case does not count."""
    is_word = word_table()[c]
    edge = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, U64), start, end
    length = end - start
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    low = lower_table()[c[is_word]].astype(U64) + U64(1)
    place = np.arange(len(low)) - np.repeat(first, length)
    return mix(np.add.reduceat(low * _powers()[place & 4095], first) + length.astype(U64) * _GOLD), start, end


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words; a shorter text is one shingle of all its words."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, U64)
    for i in range(n):
        out = out * _GOLD + h[i : len(h) - n + 1 + i]
    return mix(out ^ U64(n))
