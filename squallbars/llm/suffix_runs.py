"""Sorted runs of byte strings, front coded, merged by a loser tree that keeps common prefixes.

A run stores for each string how many bytes it shares with the one before and the rest. The tree keeps for each run's head
the bytes it shares with the last output: of two heads the one that shares more comes first, without a look at their bytes,
and if they share equally much, comparing begins behind what they share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be `start` at least."""
    most, at = min(len(a), len(b)), start
    for step in (128, 16, 1):
        while at + step <= most and a[at:at + step] == b[at:at + step]:
            at += step
    return at


def encode_run(strings: list[bytes], ids: list[int]) -> bytes:
    """A front-coded run of sorted strings with their numbers."""
    common = [0][:len(strings)] + [shared(a, b) for a, b in zip(strings[:-1], strings[1:], strict=True)]
    rest = [s[c:] for s, c in zip(strings, common, strict=True)]
    return zlib.compress(b"".join([
        np.array([len(strings)], "<i8").tobytes(), np.array(common, "<i4").tobytes(), np.array([len(r) for r in rest], "<i4").tobytes(),
        np.array(ids, "<i8").tobytes(), *rest]), 1)


def decode_run(run: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(string, bytes shared with the one before, number) in order."""
    raw = zlib.decompress(run)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    common = np.frombuffer(raw, "<i4", n, 8).tolist()
    sizes = np.frombuffer(raw, "<i4", n, 8 + 4 * n).tolist()
    ids = np.frombuffer(raw, "<i8", n, 8 + 8 * n).tolist()
    at, last = 8 + 16 * n, b""
    for c, size, number in zip(common, sizes, ids, strict=True):
        last = last[:c] + raw[at:at + size]
        at += size
        yield last, c, number


def merge_runs(runs: list[bytes]) -> Iterator[tuple[bytes, int, int]]:
    """All strings of the runs in order: (string, bytes shared with the one before, number)."""
    streams = [decode_run(r) for r in runs]
    wide = 1
    while wide < len(streams):
        wide *= 2
    heads: list[tuple[bytes, int, int] | None] = [next(s, None) for s in streams] + [None] * (wide - len(streams))
    # known[i]: bytes that head i shares with the winner it was last measured against, which all later winners exceed.
    known = [0] * wide
    losers = [0] * wide

    def play(one: int, two: int) -> tuple[int, int]:
        """(winner, loser) of two heads; the loser then knows what it shares with the winner."""
        a, b = heads[one], heads[two]
        if a is None or b is None:
            return (two, one) if a is None else (one, two)
        if known[one] != known[two]:
            return (one, two) if known[one] > known[two] else (two, one)
        c = shared(a[0], b[0], known[one])
        if (a[0][c:c + 1], one) <= (b[0][c:c + 1], two):
            known[two] = c
            return one, two
        known[one] = c
        return two, one

    def build(node: int) -> int:
        if node >= wide:
            return node - wide
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1)
    before = 0
    while heads[top] is not None:
        string, _, number = heads[top]
        yield string, known[top] if before else 0, number
        before = 1
        heads[top] = following = next(streams[top], None)
        known[top] = following[1] if following else 0  # what it shares with the string just put out, its own run's last
        node = (top + wide) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2
