"""64-bit hashes of words and of runs of words, the same on every machine."""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def wide_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word, as rows; the first isn't that of word_hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2).T


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    size, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while size < n:
            out[size : 2 * size] = out[: min(size, n - size)] * step
            size, step = 2 * size, step * step
    return out[:n]


INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high and low bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row: a polynomial in an odd base, mixed."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes)), dtype=np.uint64)])
        return mixed((sums[size:] - sums[:n]) * powers(n, INVERSE))
