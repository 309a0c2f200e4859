"""Texts as numpy arrays: word borders, and 64-bit hashes of words and of runs of words that are equal in every process."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = {0: U(0x9E3779B97F4A7C15), 1: U(0xD6E8FEB86659FD93)}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each bit depends on all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def _power(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) < n:
        base = int(_BASE[which])
        size = max(n, 1 << 16)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            pair.append(np.cumprod(p, dtype=U))
        _powers[which] = (pair[0], pair[1])
    return _powers[which]


def run_hasher(values: np.ndarray, which: int = 0):
    """A function of borders that gives the hash of values[start:end] for each pair of them, from running sums."""
    power, inverse = _power(len(values) + 1, which)
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * power[: len(values)], dtype=U, out=total[1:])
    return lambda starts, ends: mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U))


def runs_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return run_hasher(values, which)(starts, ends)


def octets(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def word_borders(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the maximal runs without ASCII white space."""
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return runs_of(_TABLE[b], starts, ends)


def byte_values(b: np.ndarray) -> np.ndarray:
    return _TABLE[b]


def grams(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of k words; empty for fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    at = np.arange(n)
    return runs_of(words, at, at + k, which)
