"""Vectorised 64-bit hashes of words and of runs of consecutive words."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

#: Odd multipliers with well-spread bits.
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[2]
    return x ^ (x >> np.uint64(29))


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the ordered pair (a, b)."""
    return scramble(a * ODD[seed] + (b ^ (b >> np.uint64(31))) * ODD[seed + 1])


def run_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of `size` consecutive entries, built from runs of powers of two."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, power, width, done = None, words, 1, 0
    while True:
        if size & width:
            part = power[done : done + count]
            out = part if out is None else pair(out, part, seed)
            done += width
        if done == size:
            return scramble(out + ODD[seed]) if size == 1 else out
        power = pair(power[:-width], power[width:], seed)
        width *= 2


def run_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each `size` consecutive entries."""
    count = len(values) - size + 1
    if count <= 0:
        return values[:0]
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:count], values[size - width : size - width + count])


def slabs(sizes: Iterable[int], most: int) -> list[tuple[int, int]]:
    """Cut rows of the given sizes into consecutive stretches of about `most` in all, one row at least."""
    out, start, total, k = [], 0, 0, -1
    for k, size in enumerate(sizes):
        if total and total + size > most:
            out.append((start, k))
            start, total = k, 0
        total += size
    return [*out, (start, k + 1)] if k >= 0 else []
