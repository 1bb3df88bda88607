"""Token ids of many texts at once with a byte-level BPE tokenizer.

The tokenizer splits a text into pre-tokens (a word with the space before it, a run of digits, of other signs, of
white space, or an English contraction) and merges inside each.  So the ids of a text are the joined ids of its
pre-tokens.  Splitting is done on arrays of code points, and each distinct pre-token is encoded once and kept in a
bounded table.  Merging by rank of the tokenizer file's own vocabulary (``tiktoken``) gives the same ids as the
``tokenizers`` library several times faster on single words; the tests compare the two on whole texts.  Added tokens
of the file that a text spells out are their own ids, as there: the text is cut at them first.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
import tiktoken

from . import textops as T

_BLOCK, _MOST_WORDS = 1 << 18, 1 << 17
_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)
_STOP = 0x110000
#: Endings that form a pre-token with the apostrophe before them.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_BREAK = regex.compile(r"(?<=\p{L}) (?=\p{L})")


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point; one more stands for the end of a text."""
    out = np.full(_STOP + 1, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, _STOP)]))
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[T.codes(m[0])] = kind
    out[_STOP] = _END
    return out


def split(c: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens among code points in which each text is followed by the end sign."""
    kind = _classes()[c]
    first = np.empty(len(c), bool)
    first[0] = True
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _END)
    run = np.flatnonzero(first[1:] & (kind[1:] < _END) & (kind[1:] > _SPACE) & (kind[:-1] == _SPACE)) + 1
    first[run - 1] = True  # the last white space of a run stands alone, or
    first[run[c[run - 1] == 32]] = False  # as a plain space with what follows
    quote = np.flatnonzero((c[:-1] == 39) & first[:-1] & (kind[1:] == _LETTER))
    for ending in sorted(CONTRACTIONS, key=len):
        at = quote[quote + len(ending) < len(c)]
        for i, ch in enumerate(ending, 1):
            at = at[c[at + i] == ord(ch)]
        first[at + 1] = False
        after = at + 1 + len(ending)
        first[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(first)


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as signs from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class FastIds:
    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that look at what stands around them are not supported")
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        byte = _byte_of_sign()
        ranks = {bytes(byte[ch] for ch in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        # a pre-token comes whole: the pattern takes all there is
        self._one = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.clear()

    def clear(self) -> None:
        """Forget all words."""
        self.place: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _learn(self, keys: list[int], texts: list[str]) -> None:
        got = list(map(self._one, texts))
        need, n = self.used + sum(map(len, got)), len(self.place)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(2 * need - self.used, np.uint32)])
        if n + len(keys) > len(self.start):
            grow = np.empty(2 * (n + len(keys)) - n, np.int64)
            self.start, self.length = np.concatenate([self.start[:n], grow]), np.concatenate([self.length[:n], grow])
        for key, ids in zip(keys, got, strict=True):
            at = len(self.place)
            self.place[key] = at
            self.start[at], self.length[at] = self.used, len(ids)
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        c = np.concatenate([np.append(T.codes(t), np.uint32(_STOP)) for t in texts])
        start = split(c)
        length = np.diff(start, append=len(c))
        place = np.arange(len(c)) - np.repeat(start, length)
        h = np.add.reduceat((c.astype(np.uint64) + np.uint64(1)) * T._powers()[place & 4095], start)
        h = T.mix(h + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ends = c[start] == _STOP
        keys, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.place) > _MOST_WORDS:
            self.clear()
        found = list(map(self.place.get, keys.tolist()))
        new = [i for i, k in enumerate(found) if k is None]
        if new:
            joined = "\0".join(texts) + "\0"
            w = where[new]
            stop = ends[w]
            first = len(self.place)
            self._learn(keys[new].tolist(), ["" if e else joined[a : a + n] for a, n, e in zip(start[w].tolist(), length[w].tolist(), stop.tolist(), strict=True)])
            for at, i in enumerate(new, first):
                found[i] = at
        at = np.array(found, np.int64)[back]
        n = self.length[at]
        total = np.cumsum(n)
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.start[at] - (total - n), n)]
        return np.split(ids, total[ends][:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, added tokens among them."""
        if self._added is None or not any(token in text for token in self.added for text in texts):
            return self._encode(texts)
        cut = [self._added.split(text) for text in texts]  # every other part is an added token
        plain = iter(self._encode([part for parts in cut for part in parts[::2]]))
        return [np.concatenate([np.array([self.added[part]], np.uint32) if k % 2 else next(plain) for k, part in enumerate(parts)]) for parts in cut]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, blocks of about a quarter of a million characters at a time."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        block: list[str] = []
        owner: list[int] = []
        size = 0

        def close() -> None:
            nonlocal size
            if block:
                for i, ids in zip(owner, self._block(block), strict=True):
                    out[i].append(ids)
            block.clear(), owner.clear()
            size = 0

        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = len(text)
                if cut - at > _BLOCK and (m := _BREAK.search(text, at + _BLOCK)):
                    cut = m.start()  # between two words, where no pre-token crosses
                block.append(text[at:cut]), owner.append(i)
                size += cut - at
                at = cut
                if size >= _BLOCK:
                    close()
        close()
        return [np.concatenate(x) if x else np.empty(0, np.uint32) for x in out]


@lru_cache(2)
def fast_ids(tokenizer_json: str) -> FastIds:
    return FastIds(tokenizer_json)
