"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string arrays.  They are joined into one byte buffer per
block, and words, shingles and hashes are computed for the whole block with
numpy, so that no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:
    # Freed arrays of a MB or more go back to the system at once: by default idle workers would keep them.
    ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)
except (OSError, AttributeError):
    pass

#: 0x20 and 0x09-0x0D part words.
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 64), _MUL, dtype=np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that every bit of the result depends on every bit given."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit units each; one text is never cut."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


class Words:
    """Words of a block of texts (runs of bytes not in parts): doc (index of the text), start and end (bytes in buf), count and first by text."""

    def __init__(self, texts: list[bytes], lower: bool = True, parts: np.ndarray = _SEP):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lens + 1)))
        word = ~parts[self.buf]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.inside = word
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf[self.inside], self.end - self.start)


def span_hashes(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the adjoining spans (none empty) that make up data."""
    if not len(lens):
        return np.zeros(0, dtype=np.uint64)
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    h = _BYTE[data]
    h *= powers(int(lens.max()))[np.arange(len(data)) - np.repeat(at, lens)]
    return mix(np.add.reduceat(h, at) + lens.astype(np.uint64))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k neighbours in h, whatever text they are in."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= _MUL
        out += h[i : n + i]
    return mix(out)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; the whole sequence is one shingle when it is shorter."""
    h = words.hashes()
    all_windows = windows(h, k)
    out = []
    for first, n in zip(words.first, words.count):
        if n >= k:
            out.append(np.unique(all_windows[first : first + n - k + 1]))
        elif n:
            out.append(windows(h[first : first + n], int(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def list_array(values: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
