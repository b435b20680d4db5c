"""Word and n-gram hashes of a whole Arrow batch of texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_P_INV = U(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, U), np.ones(1, U)]

#: Bytes that part words: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII other than letters and digits parts words; for matching that ignores punctuation.
PUNCT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        m = max(n + 1, 1 << 16)
        for k, base in enumerate((_P, _P_INV)):
            a = np.full(m, base, U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts one after the other, and where each starts (one more at the end); null is empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a batch of texts: hash, first byte, end byte, and for each text the range of its words (`first[i]` to `first[i + 1]`)."""

    def __init__(self, column: pa.Array, part: np.ndarray = SPACE):
        self.data, self.at = buffers(column)
        n = len(self.data)
        inside = ~part[self.data]
        before = np.empty(n, bool)
        before[1:] = inside[:-1]
        if n:
            before[0] = False
            before[self.at[:-1][self.at[:-1] < n]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[:-1] = inside[1:]
        if n:
            after[-1] = False
            ends = self.at[1:] - 1
            after[ends[ends >= 0]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        power, inverse = _power(n)
        total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[self.data] * power[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * inverse[self.start]
        self.hash = mix(h ^ ((self.end - self.start).astype(U) * U(0xA0761D6478BD642F)))
        self.first = np.searchsorted(self.start, self.at)

    def exact(self) -> np.ndarray:
        """A number for each word, equal where and only where the bytes are: for checks that a hash can't settle."""
        size = self.end - self.start
        at = np.concatenate([[0], np.cumsum(size)])
        inside = np.repeat(self.start - at[:-1], size) + np.arange(at[-1])
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data[inside]))])
        return numbered(words)

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words within a text, and the word at which each starts."""
        return grams(self.hash, self.first, k)


def numbered(values: pa.Array) -> np.ndarray:
    """A number for each value, in order of first sight."""
    return pc.dictionary_encode(values).indices.to_numpy().astype(np.int64)


def exact_windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of the windows of k words, numbered by the bytes of their words; a text of fewer words is one window."""
    words, n = w.exact(), np.diff(w.first)
    padded = np.concatenate([words, np.full(k, -1)]) + 1  # 0 stands for no word
    doc = w.doc()
    place = np.arange(len(words)) - w.first[doc]
    at = np.flatnonzero((place == 0) | (place + k <= n[doc]))
    code, size = padded[at], int(padded.max(initial=0)) + 1
    for j in range(1, k):
        code = numbered(pa.array(code * size + np.where(place[at] + j < n[doc[at]], padded[at + j], 0)))
    return doc[at], code


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of equally long columns of hashes, in order."""
    h = parts[0] * U(0x9FB21C651E98DF25)
    for p in parts[1:]:
        h = (h ^ (h >> U(29))) * U(0x9FB21C651E98DF25) + p
    return mix(h)


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(h)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    at = np.flatnonzero(left[: n - k + 1] >= k)
    return chain([h[at + j] for j in range(k)]), at
