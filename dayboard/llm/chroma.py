"""Chroma fingerprints of recordings, and their alignment.

A recording becomes pitch-class frames (twelve energies each), an integral image over them answers sixteen
rectangle filters for every window of frames, and the filters' values, two bits each, are packed into one integer
a window.  Recordings with equal integers (two, ``STEP`` windows apart) vote on the offset between them; a query also
asks with the bits flipped that lie nearest to a threshold, which is where noise changes them.  The offset with most
votes aligns the two, and the share of differing bits over their overlap says whether they hold the same sound.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .storage import Stash

RATE, FRAME, HOP, SPAN, STEP = 2000, 512, 128, 16, 3
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
_STEPS = (-0.12, 0.0, 0.12)
_GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Which of a filter's two bits changes at each threshold.
_FLIPS = np.array([0, 1, 0], np.uint8)


def wav_bytes(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.clip(samples, -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in -1 to 1 and the rate; null, empty and broken files give no samples."""
    try:
        with wave.open(io.BytesIO(data or b""), "rb") as w:
            n, width, rate, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
        kind = {1: np.uint8, 2: "<i2", 4: "<i4"}[width]
        x = np.frombuffer(raw[: len(raw) // (n * width) * n * width], kind).reshape(-1, n).mean(axis=1)
    except (wave.Error, EOFError, KeyError):
        return np.empty(0), RATE
    return ((x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))), rate


@lru_cache(8)
def _pitch_classes(rate: int, size: int) -> np.ndarray:
    """FFT bins x pitch classes, for 55 Hz up to half the rate."""
    hz = np.fft.rfftfreq(size, 1 / rate)
    out = np.zeros((len(hz), 12))
    use = np.flatnonzero((hz >= 55) & (hz < 3520))
    out[use, np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    return out


def chroma(recordings: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """Smoothed frames x 12 of unit length for each recording (samples, rate); silence stays zero.

    Frames scale with the rate.  Frames of many recordings are transformed together.
    """
    out: list[np.ndarray] = [np.zeros((0, 12))] * len(recordings)
    for rate in {r for x, r in recordings if len(x) and HOP * r // RATE}:
        size, hop = FRAME * rate // RATE, HOP * rate // RATE
        at = [i for i, (x, r) in enumerate(recordings) if r == rate and len(x)]
        views = []
        for i in at:
            x = recordings[i][0]
            x = np.concatenate([x, np.zeros(max(0, size - len(x)) + (-(max(len(x), size) - size)) % hop)])
            views.append(np.lib.stride_tricks.sliding_window_view(x, size)[::hop])
        n = np.array([len(v) for v in views])
        energy = np.concatenate(list(_energies(views, rate, size)))
        # the frames next to a recording's ends count for those beyond
        edge = np.concatenate([np.clip(np.arange(-2, k + 2), 0, k - 1) + a for k, a in zip(n, np.cumsum(n) - n, strict=True)])
        padded = energy[edge]
        smooth = sum(w * padded[i : i + len(padded) - 4] for i, w in enumerate(_SMOOTH))
        norm = np.linalg.norm(smooth, axis=1, keepdims=True)
        unit = np.where(norm > 1e-6, smooth / np.maximum(norm, 1e-12), 0)
        for i, k, a in zip(at, n, np.cumsum(n + 4) - n - 4, strict=True):
            out[i] = unit[a : a + k]
    return out


def _energies(views: list[np.ndarray], rate: int, size: int, most: int = 1024) -> Iterator[np.ndarray]:
    """Energy by pitch class of all frames, so many at a time."""
    window, pitch = np.hanning(size), _pitch_classes(rate, size)
    part: list[np.ndarray] = []
    have = 0
    for view in views:
        for a in range(0, len(view), most):
            part.append(view[a : a + most])
            have += len(part[-1])
            if have >= most:
                yield _power(np.concatenate(part) * window) @ pitch
                part, have = [], 0
    if part:
        yield _power(np.concatenate(part) * window) @ pitch


def _power(frames: np.ndarray) -> np.ndarray:
    x = np.fft.rfft(frames, axis=1)
    return x.real**2 + x.imag**2


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen (shape, first pitch class, pitch classes, frames), by a rule that covers classes and scales evenly."""
    return [(i % 6, (5 * i) % 9, 3 + (i // 6) % 2 * 3 if (5 * i) % 9 < 7 else 3, (4, 8, 12, 16)[i % 4]) for i in range(16)]


def fingerprint(recordings: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One unsigned 32-bit integer a window of ``SPAN`` frames of each recording, and the numbers of its two bits that
    are nearest to a threshold; shorter recordings are padded to one window.

    Energies are counted in steps of 1/4096, so that sums over many recordings are exact.
    """
    length = np.array([max(len(f), SPAN) if len(f) else 0 for f in recordings], np.int64)
    if not length.sum():
        return [(np.empty(0, np.uint32), np.empty((0, 2), np.uint8)) for _ in recordings]
    total = np.zeros((length.sum() + 1, 13), np.int64)
    ends = np.cumsum(length)
    for f, e, k in zip(recordings, ends, length, strict=True):
        total[e - k + 1 : e - k + 1 + len(f), 1:] = np.rint(f * 4096)
    total = total.cumsum(0).cumsum(1)
    n = len(total) - SPAN

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return (total[t1 : t1 + n, p1] - total[t0 : t0 + n, p1] - total[t1 : t1 + n, p0] + total[t0 : t0 + n, p0]) / 4096

    out, weak, margin = np.zeros(n, np.uint32), np.zeros((n, 2), np.uint8), np.full((n, 2), np.inf)
    for i, (shape, p, high, wide) in enumerate(filters()):
        q, half, mid, third, band = p + high, wide // 2, p + high // 2, wide // 3, max(1, high // 3)
        whole = area(0, wide, p, q)
        if shape == 0:
            a = whole
            b = area(0, wide, 0, 12) - whole
            b = b * high / max(12 - high, 1)
        elif shape == 1:
            a = area(0, wide, p, mid)
            b = whole - a
        elif shape == 2:
            a = area(0, half, p, q)
            b = whole - a
        elif shape == 3:
            a = area(0, half, p, mid) + area(half, wide, mid, q)
            b = whole - a
        elif shape == 4:
            a = area(0, wide, p + band, q - band)
            b = whole - a
        else:
            a = area(third, wide - third, p, q)
            b = whole - a
        value = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(_STEPS, value)]
        far = np.abs(value[:, None] - np.array(_STEPS))
        at = far.argmin(axis=1)
        far, bit = far[np.arange(n), at], (2 * (15 - i) + _FLIPS[at]).astype(np.uint8)
        first = far < margin[:, 0]
        weak[first, 1], margin[first, 1] = weak[first, 0], margin[first, 0]
        weak[first, 0], margin[first, 0] = bit[first], far[first]
        second = ~first & (far < margin[:, 1])
        weak[second, 1], margin[second, 1] = bit[second], far[second]
    spans = [slice(e - k, e - SPAN + 1 if k else e) for e, k in zip(ends, length, strict=True)]
    return [(out[s], weak[s]) for s in spans]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        found = fingerprint(chroma([read_wav(x) for x in batch.column("audio").to_pylist()]))
        prints = [p.astype("<u4").tobytes() for p, _ in found]
        digest = [hashlib.blake2b(p, digest_size=16).digest() if p else None for p in prints]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary()), pa.array(digest, pa.binary())], names=["id", "prints", "weak", "digest"])


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """``(id, prints, weak, digest)``: little-endian 32-bit integers, the numbers of two weak bits of each, and a digest
    that equal recordings share.

    Audio that is null, empty or not WAV has empty prints and a null digest.
    """
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).alias("audio"))
    return rows.mapInArrow(_prints, "id long, prints binary, weak binary, digest binary")


def _positions(batches: Iterator[pa.RecordBatch], probe: bool) -> Iterator[pa.RecordBatch]:
    """Where each key stands: an integer with the one ``STEP`` windows on, which chance hardly repeats.

    With ``probe``, also the fifteen keys that differ from it in weak bits.
    """
    one = np.uint64(1)
    for batch in T.slices(batches):
        ids, keys, places = [], [], []
        for i, p, w in zip(*(batch.column(n).to_pylist() for n in ("id", "prints", "weak")), strict=True):
            x = np.frombuffer(p, "<u4").astype(np.uint64)
            key = (x[:-STEP] << np.uint64(32)) | x[STEP:]
            # of a run of equal keys, as in a held note, the first one is listed
            at = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.empty(0, np.int64)
            key = key[at]
            if probe:
                bits = one << np.frombuffer(w, np.uint8).reshape(-1, 2).astype(np.uint64)
                for flip in (bits[at, 0] << np.uint64(32), bits[at, 1] << np.uint64(32), bits[at + STEP, 0], bits[at + STEP, 1]):
                    key = np.concatenate([key, key ^ np.resize(flip, len(key))])
                at = np.resize(at, len(key))
            ids.append(np.full(len(at), i)), keys.append(key.view(np.int64)), places.append(at.astype(np.int32))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, keys, places)], names=["id", "key", "at"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ber, over = [], []
        for a, b, off in zip(batch.column("prints_q").to_pylist(), batch.column("prints_m").to_pylist(), batch.column("frame_offset").to_pylist(), strict=True):
            x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
            lo, hi = max(0, -off), min(len(x), len(y) - off)
            diff = np.bitwise_count(x[lo:hi] ^ y[lo + off : hi + off])
            over.append(hi - lo), ber.append(float(diff.sum()) / (32 * (hi - lo)))
        names = ["query_class", "match_class", "frame_offset", "votes"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(over, pa.int32()), pa.array(ber, pa.float64())], names=[*names, "overlap", "bit_error"])


def align(prints: DataFrame, queries: DataFrame, *, min_votes: int = 1, min_overlap: int = 4, max_error: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Search ``queries(id)`` among all ``prints``: classes ``(id, class_id)`` and matches between classes.

    Recordings with equal prints are one class, named by its smallest id, and are found together.  A match has the
    offset (in frames, what the query's first frame is in the match) with most votes, ties to the smaller offset.
    Overlaps are ``min_overlap`` windows at least, so recordings of fewer match equal ones only.  Recordings without
    prints are classes of their own and match nothing; null ids take no part.
    """
    stash = Stash(prints.sparkSession, "chroma")
    prints = stash.put(prints.where("id is not null"))
    first = prints.where("digest is not null").groupBy("digest").agg(F.min("id").alias("class_id"))
    members = stash.put(prints.select("id", "digest").join(first, "digest", "left").select("id", F.coalesce("class_id", "id").alias("class_id")))
    reps = stash.put(prints.where("digest is not null").join(first.withColumnRenamed("class_id", "id"), ["digest", "id"]).groupBy("id").agg(F.min(F.struct("prints", "weak")).alias("p")).select("id", "p.*"))
    asked = members.join(queries.select("id"), "id", "left_semi").select(F.col("class_id").alias("id")).distinct()
    place = lambda d, probe=False: d.mapInArrow(lambda it: _positions(it, probe), "id long, key long, at int")
    q = place(reps.join(asked, "id", "left_semi"), True).withColumnsRenamed({"id": "query_class", "at": "at_q"})
    m = place(reps).withColumnsRenamed({"id": "match_class", "at": "at_m"})
    votes = q.join(m, "key").where("query_class <> match_class").groupBy("query_class", "match_class", (F.col("at_m") - F.col("at_q")).alias("frame_offset")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("query_class", "match_class").agg(F.max(F.struct("votes", (-F.col("frame_offset")).alias("back"))).alias("b"))
    best = best.select("query_class", "match_class", (-F.col("b.back")).alias("frame_offset"), F.col("b.votes").alias("votes")).where(F.col("votes") >= min_votes)
    side = lambda x: reps.select(F.col("id").alias("query_class" if x == "q" else "match_class"), F.col("prints").alias(f"prints_{x}"))
    both = best.join(side("q"), "query_class").join(side("m"), "match_class")
    found = both.mapInArrow(_compare, "query_class long, match_class long, frame_offset int, votes long, overlap int, bit_error double")
    return members, found.where((F.col("overlap") >= min_overlap) & (F.col("bit_error") <= max_error))


def _sonify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One short note per word of a text, its pitch drawn from the word's hash."""
    t = np.arange(HOP) / RATE
    notes = np.stack([sum(np.sin(2 * np.pi * 110 * 2 ** (k / 12) * h * t) / h for h in (1, 2)) for k in range(24)])
    notes = (notes * np.hanning(HOP + 2)[1:-1] * 12000).astype("<i2")
    for part in T.slices(batches):
        audio = [wav_bytes(notes[(T.words(T.codes(x))[0] >> np.uint64(40)).astype(np.int64) % 24].ravel()) if x else None for x in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(audio, pa.binary())], names=["id", "audio"])


def sonify(texts: DataFrame) -> DataFrame:
    """``(id, text)`` -> ``(id, audio)``: WAV recordings of whole texts, as test material where no audio is at hand."""
    return texts.select("id", "text").mapInArrow(_sonify, "id long, audio binary")
