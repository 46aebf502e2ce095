"""Vectorised byte-level text primitives (numpy) used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1_000_000  # bytes of text turned into arrays at once


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result can be used."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def points(text: str) -> np.ndarray:
    """The characters of a text as numbers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Rolling:
    """Hashes of any byte range of a buffer in constant time (prefix sums modulo 2**64). Equal bytes have
    equal hashes wherever they stand."""

    _powers = _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling._powers) < n + 1:
            size = max(n + 1, 2 * len(Rolling._powers))
            for name, base in (("_powers", ODD), ("_inverse", np.uint64(pow(int(ODD), -1, 1 << 64)))):
                full = np.full(size, base, np.uint64)
                full[0] = 1
                setattr(Rolling, name, np.cumprod(full, dtype=np.uint64))
        self.n = n
        self.c = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[:n], out=self.c[1:])

    def span(self, start, end) -> np.ndarray:
        return mix((self.c[end] - self.c[start]) * self._inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k-byte strings, by start."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        return mix((self.c[k:] - self.c[:-k]) * self._inverse[: self.n - k + 1])


def chunks(texts: list, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Cut a list of byte strings into ranges of about size bytes; at least one text each."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and (total + len(t) > size or i - start >= 2000):
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def values(strings) -> list[bytes]:
    """The items of an Arrow binary array without nulls, cut from one copy of its bytes."""
    _, offsets, data = strings.buffers()
    kind = np.int64 if str(strings.type).startswith("large") else np.int32
    at = np.frombuffer(offsets, kind)[strings.offset : strings.offset + len(strings) + 1].tolist() if len(strings) else [0]
    raw = data.slice(at[0], at[-1] - at[0]).to_pybytes() if data is not None else b""
    return [raw[a - at[0] : b - at[0]] for a, b in zip(at, at[1:])]


def word_spans(is_word: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of maximal runs of word bytes. is_word must be False at the byte
    before each text after the first, so texts are joined by a separator."""
    d = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    s, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    return s, e, np.searchsorted(bases, s, side="right") - 1
