"""Counting quotient filters that lose nothing.

A key of ``bits`` bits (64 at least) is permuted invertibly. The top bits of
the permuted key name a part, the next ones are the quotient, and all the rest
is kept as the remainder, so a filter gives back every key and its count. A
serialised filter holds, in the order of permuted keys: a bit per quotient
(does it occur), a bit per entry (does its quotient's run end here), the
remainders in whole bytes, and a byte per count with larger counts apart.
"""

from __future__ import annotations

import numpy as np

from sulatan.llm.words import mix

_A, _B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_A_BACK, _B_BACK = (np.uint64(pow(x, -1, 1 << 64)) for x in (_A, _B))
_LARGE = 255


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of `words.mix`."""
    h = (h ^ (h >> np.uint64(32))) * _B_BACK
    h = (h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))) * _A_BACK
    return h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))


def pack(ids: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Ids of ``width`` bits side by side in 64-bit limbs, the first id lowest."""
    limbs = [np.zeros(len(ids[0]), np.uint64) for _ in range(-(-len(ids) * width // 64))]
    for k, x in enumerate(ids):
        limb, shift = divmod(k * width, 64)
        limbs[limb] |= x << np.uint64(shift)
        if shift + width > 64:
            limbs[limb + 1] |= x >> np.uint64(64 - shift)
    return limbs


def unpack(limbs: list[np.ndarray], width: int, n: int) -> list[np.ndarray]:
    mask = np.uint64((1 << width) - 1)
    ids = []
    for k in range(n):
        limb, shift = divmod(k * width, 64)
        x = limbs[limb] >> np.uint64(shift)
        if shift + width > 64:
            x = x | limbs[limb + 1] << np.uint64(64 - shift)
        ids.append(x & mask)
    return ids


def _fold(limbs: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(limbs[0]), np.uint64)
    for k, x in enumerate(limbs[1:]):
        out ^= mix(x + np.uint64(0xA0761D6478BD642F * (k + 1) & (1 << 64) - 1))
    return out


def permute(limbs: list[np.ndarray]) -> list[np.ndarray]:
    """The lowest limb becomes a scrambling of the whole key; given the others it can be undone."""
    return [mix(limbs[0] ^ _fold(limbs)), *limbs[1:]]


def restore(limbs: list[np.ndarray]) -> list[np.ndarray]:
    return [unmix(limbs[0]) ^ _fold(limbs), *limbs[1:]]


def counted(limbs: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Permuted keys in order, each once, with their counts added up. Sorted input is merged."""
    if not len(counts):
        return limbs, counts
    order = np.argsort(limbs[0], kind="stable")
    limbs = [x[order] for x in limbs]
    counts = counts[order]
    same = limbs[0][1:] == limbs[0][:-1]
    if any((x[1:] != x[:-1])[same].any() for x in limbs[1:]):  # keys that share a first limb: order by all limbs
        order = np.lexsort(limbs[::-1])
        limbs, counts = [x[order] for x in limbs], counts[order]
        same = np.logical_and.reduce([x[1:] == x[:-1] for x in limbs])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return [x[first] for x in limbs], np.add.reduceat(counts, first)


def parts_of(limbs: list[np.ndarray], part_bits: int) -> np.ndarray:
    """Bounds of the parts 0 to ``2 ** part_bits - 1`` in sorted permuted keys."""
    edges = np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits) if part_bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(limbs[0], edges), [len(limbs[0])]])


def _bytes_of(x: np.ndarray, bits: int) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8)[:, : -(-bits // 8)]


def dump(limbs: list[np.ndarray], counts: np.ndarray, part_bits: int, bits: int) -> bytes:
    """A filter of sorted, distinct permuted keys of one part."""
    n = len(counts)
    q = min(max(0, n.bit_length() - 1), 64 - part_bits)
    low = 64 - part_bits - q
    below = limbs[0] & np.uint64((1 << 64 - part_bits) - 1)
    quotient = (below >> np.uint64(low) if q else np.zeros(n, np.uint64)).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True)[:n]
    columns = [_bytes_of(below & np.uint64((1 << low) - 1), low)]
    columns += [_bytes_of(x, min(64, bits - 64 * (k + 1))) for k, x in enumerate(limbs[1:])]
    large = counts >= _LARGE
    return b"".join([np.array([n, q], np.int64).tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
                     np.concatenate(columns, axis=1).tobytes(), np.where(large, _LARGE, counts).astype(np.uint8).tobytes(), counts[large].astype(np.int64).tobytes()])


def load(raw: bytes, part: int, part_bits: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Permuted keys and counts of a filter."""
    n, q = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    low, at = 64 - part_bits - q, 16

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(raw, np.uint8, size, at - size)

    occupied = np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q)
    ends = np.unpackbits(take(-(-n // 8)), count=n)
    sizes = [-(-low // 8), *(-(-min(64, left) // 8) for left in range(bits - 64, 0, -64))]
    table = take(n * sum(sizes)).reshape(n, sum(sizes))
    counts = take(n).astype(np.int64)
    large = counts == _LARGE
    counts[large] = np.frombuffer(raw, np.int64, int(large.sum()), at)
    limbs, begin = [], 0
    for size in sizes:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = table[:, begin : begin + size]
        limbs.append(wide.view(np.uint64).reshape(n))
        begin += size
    run = np.cumsum(ends) - ends
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64) if n else np.zeros(0, np.uint64)
    if q:
        limbs[0] |= quotient << np.uint64(low)
    if part_bits:
        limbs[0] |= np.uint64(part << 64 - part_bits)
    return limbs, counts


def merge(filters: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts of equal keys added over sorted filters of one part."""
    width = len(filters[0][0])
    return counted([np.concatenate([f[0][k] for f in filters]) for k in range(width)], np.concatenate([f[1] for f in filters]))
