"""Anchors of byte texts: positions chosen by content, one in every window, and digests of what surrounds them.

An anchor of a window is the place of its least digest of `GRAM` bytes, the leftmost of equals. Two windows of equal bytes
have their anchors at the same offset, so windows can only be equal if the suffixes at their anchors share what is right of
the anchor and the reversed prefixes share what is left of it.
"""

from __future__ import annotations

import numpy as np

GRAM = 64
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_SLICE = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Sums:
    """Running polynomial sums of a text's bytes, for digests of any part of it."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray, base: int):
        self.base, n = base, len(raw)
        forth, self.back = self._power(base, n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(7)) * forth[:n], out=self.total[1:], dtype=np.uint64)

    @classmethod
    def _power(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = cls._powers.get(base)
        if held is None or len(held[0]) < n:
            n = max(1 << 16, 1 << (n - 1).bit_length())
            held = []
            for b in (_BASES[base], _INVERSES[base]):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                held.append(np.cumprod(steps, dtype=np.uint64))
            cls._powers[base] = tuple(held)
        return cls._powers[base]

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64))


def _window_least(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of every `wide` values in a row."""
    n = len(values) - wide + 1
    full = -(-len(values) // wide) * wide
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[wide - 1:wide - 1 + n])


def anchors(raw: np.ndarray, length: int, sums: Sums, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last, gram digest): every anchor of the windows of `length` bytes and the windows that choose it.

    `ends` are where texts in `raw` end, one behind the other; no window crosses them (none given: one text).
    """
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    wide = length - GRAM + 1
    places = []
    for at in range(0, n - length + 1, _SLICE):
        end = min(n - length + 1, at + _SLICE)  # windows [at, end)
        start = np.arange(at, end + wide - 1)
        packed = (sums.digest(start, start + GRAM) & ~_PLACE) | (start - at).astype(np.uint64)
        places.append((_window_least(packed, wide) & _PLACE).astype(np.int64) + at)
    chosen, window = np.concatenate(places), np.arange(n - length + 1)
    if ends is not None:
        window = window[window + length <= np.repeat(ends, np.diff(ends, prepend=0))[:len(window)]]
        chosen = chosen[window]
    edge = np.flatnonzero(np.diff(chosen, prepend=-1))
    place = chosen[edge]
    return place, window[edge], window[np.append(edge[1:], len(chosen)) - 1] if len(edge) else edge, sums.digest(place, place + GRAM)
