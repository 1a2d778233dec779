"""Words of Arrow text columns as numpy arrays, without a Python step per word.

A word's 64-bit hash is a sum of random byte values times powers of an odd
base, taken from prefix sums, then mixed. Long texts are cut at separators so
that working memory stays within a few dozen times ``PIECE_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 18
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_ASCII = np.arange(256) < 128
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
#: separators when only letters, digits and non-ASCII bytes make words
NON_WORD = _ASCII & ~_ALNUM


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_BASE = 0x5851F42D4C957F2D
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE, np.uint64)
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    return np.cumprod(base), np.cumprod(back)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``[start, end)`` of a sequence of 64-bit values."""
    size = 1 << max(12, int(len(values) + 1).bit_length())
    base, back = _powers(size)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * base[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of rows ``lo`` to ``hi`` of a batch; row r owns ``at[r-lo]:at[r-lo+1]``."""

    lo: int
    hi: int
    at: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def rows(self) -> np.ndarray:
        """Row number of each word, from 0."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.at))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its offsets; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def _piece(data: np.ndarray, lo: int, hi: int, breaks: np.ndarray, classes: np.ndarray, values: np.ndarray):
    part = data[lo:hi]
    kind = classes[part]
    word = kind > 0
    first, last = word.copy(), word.copy()
    change = kind[1:] != kind[:-1]
    first[1:] &= change
    last[:-1] &= change
    inner = breaks[(breaks > lo) & (breaks < hi)] - lo
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts + lo, ends + lo, span_hashes(values[part], starts, ends)


#: classes of bytes, 0 for separators; a word is a run of one class
SHAPES = np.where(SPACES, 0, np.where(_ASCII & ~_ALNUM, np.arange(256) % 128 + 10, 1)).astype(np.uint8)
SHAPES[65:91], SHAPES[48:58] = 2, 3


def words(column: pa.Array, separators: np.ndarray = SPACES, lower: bool = True, classes: np.ndarray | None = None) -> Iterator[Words]:
    """Words of a text column, a few rows at a time; a long text comes whole."""
    data, at = text_bytes(column)
    classes = (~separators).astype(np.uint8) if classes is None else classes
    separators = classes == 0
    values = _LOWER if lower else _BYTE
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE_BYTES, "right")) - 1)
        begin, end = int(at[lo]), int(at[hi])
        found = []
        while begin < end:
            cut = min(end, begin + PIECE_BYTES)
            while cut < end:  # go back to a separator, or on to the next one
                near = np.flatnonzero(separators[data[begin:cut]])
                if len(near):
                    cut = begin + int(near[-1]) + 1
                    break
                cut = min(end, cut + PIECE_BYTES)
            found.append(_piece(data, begin, cut, at[lo : hi + 1], classes, values))
            begin = cut
        starts, ends, hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        yield Words(lo, hi, np.searchsorted(starts, at[lo : hi + 1]), hashes, starts, ends, data)
        lo = hi


def runs(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size``-word run and the run offsets per row.

    A row with fewer words has one run, all its words; without words, none.
    """
    n = np.diff(w.at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    pos = np.repeat(w.at[:-1] - at[:-1], count) + np.arange(at[-1])
    end = np.minimum(pos + size, np.repeat(w.at[1:], count))
    out = np.zeros(len(pos), np.uint64)
    for k in range(size):
        live = pos + k < end
        out[live] += w.hashes[pos[live] + k] * np.uint64(2 * k + 3) ** np.uint64(9)
    return mix(out + (end - pos).astype(np.uint64)), at
