"""Word shingles of texts as 64-bit digests, MinHash values and the Bayesian stop rule, in numpy."""

from __future__ import annotations

import math

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the longest text so far."""
    if len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_digests(text: str) -> np.ndarray:
    """A digest of each word of a text in lower case; words are runs of bytes other than ASCII white space.

    Digests are polynomials in the word's bytes, from running sums over the whole text.
    """
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=total[1:], dtype=np.uint64)
    return mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of a text, sorted; a text of fewer words is one shingle, one without words has none."""
    digest = word_digests(text or "")
    if not len(digest):
        return digest
    wide = min(words, len(digest))
    total = np.zeros(len(digest) - wide + 1, np.uint64)
    for k in range(wide):
        total = total * _STEP + digest[k:len(digest) - wide + 1 + k]
    return np.unique(mixed(total + np.uint64(wide)))


def min_hashes(found: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The upper 32 bits of the least hash of a non-empty set under each function."""
    a, b = seeds
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (found[at:at + 512, None] * a + b).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def hash_seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, count + 1, dtype=np.uint64)
    return mixed(at * _STEP) | np.uint64(1), mixed(at * _BASE)


def least_matches(threshold: float, tolerance: float, most: int) -> np.ndarray:
    """For n hashes compared, the least number of equal ones for which the pair goes on.

    With a uniform prior the similarity given m equal of n is Beta(m + 1, n - m + 1); its chance to reach the threshold is
    the chance that a binomial of n + 1 trials with the threshold as rate is at most m.
    """
    out = np.zeros(most + 1, np.int64)
    for n in range(1, most + 1):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, together: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all sets at `left` with all at `right`, as products of 0/1 matrices by columns.

    Shingles that only one set holds have no column.
    """
    used = np.unique(np.concatenate([left, right]))
    place = {int(u): i for i, u in enumerate(used)}
    flat = np.concatenate([sets[u] for u in used])
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    common = seen[column] > 1
    row, column = row[common], column[common]
    number = np.cumsum(seen > 1) - 1
    column = number[column]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    a, b = np.array([place[int(u)] for u in left]), np.array([place[int(u)] for u in right])
    out = np.zeros((len(left), len(right)), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, together):
        lo, hi = np.searchsorted(column, [at, at + together])
        dense = np.zeros((len(used), min(together, last - at)), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        out += dense[a] @ dense[b].T
    return out
