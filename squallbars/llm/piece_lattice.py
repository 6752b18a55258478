"""Words as lattices of vocabulary pieces: sums over all segmentations, forwards and backwards, in numpy batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CELLS = 2_000_000


class Lattice:
    """All pieces of a fixed vocabulary, found by walking a word from each place as long as some piece goes on.

    A letter that no piece begins with alone is a piece of its own, numbered `len(pieces)`.
    """

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max((len(p) for p in pieces), default=1)
        self.table = {p[:e]: -1 for p in pieces for e in range(1, len(p))}
        self.table |= {p: i for i, p in enumerate(pieces)}

    def batches(self, words: list[str]) -> Iterator[list[int]]:
        """Places of words in runs of like length whose arrays stay small."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order:
            wide = len(words[order[-1]]) * min(self.longest, len(words[order[-1]])) or 1
            most = max(1, CELLS // wide // 4)
            yield order[-most:]
            order = order[:-most]

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of every piece inside every word."""
        row, start, end, piece = [], [], [], []
        known, none, table = self.size, -2, self.table
        for i, w in enumerate(words):
            n = len(w)
            for s in range(n):
                got = table.get(w[s], none)
                if got < 0:
                    row.append(i), start.append(s), end.append(s + 1), piece.append(known)
                    if got == none:
                        continue
                else:
                    row.append(i), start.append(s), end.append(s + 1), piece.append(got)
                for e in range(s + 2, n + 1):
                    got = table.get(w[s:e], none)
                    if got == none:
                        break
                    if got >= 0:
                        row.append(i), start.append(s), end.append(e), piece.append(got)
        return tuple(np.array(x, np.int32) for x in (row, start, end, piece))

    def log_likelihood(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of the products of piece probabilities: (words, columns of `probability`).

        `probability` has a row for each piece and one for letters without a piece. Partial sums are rescaled as a word goes on.
        """
        out = np.zeros((len(words), probability.shape[1]))
        padded = np.vstack([probability, np.zeros(probability.shape[1])])
        for places in self.batches(words):
            some = [words[i] for i in places]
            n = np.array([len(w) for w in some])
            row, start, end, piece = self.arcs(some)
            reach = int((end - start).max(initial=1))
            by = np.full((len(some), n.max(initial=0) + 1, reach + 1), len(probability), np.int32)
            by[row, end, end - start] = piece
            ahead = np.zeros((len(some), n.max(initial=0) + 1, probability.shape[1]))
            ahead[:, 0] = 1
            logs = np.zeros((len(some), probability.shape[1]))
            for t in range(1, n.max(initial=0) + 1):
                back = np.arange(min(reach, t), 0, -1)
                ahead[:, t] = (ahead[:, t - back] * padded[by[:, t, back]]).sum(1)
                done = n == t
                if done.any():
                    out[np.array(places)[done]] = np.log(ahead[done, t]) + logs[done]
                if t % 16 == 0:
                    window = slice(max(0, t - reach + 1), t + 1)
                    top = ahead[:, window].max(1)
                    top[top == 0] = 1
                    ahead[:, window] /= top[:, None]
                    logs += np.log(top)
        return out

    def expected(self, words: list[str], counts: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, for one column of probabilities.

        For training; words here are short (`train` leaves longer ones out), so sums need no rescaling.
        """
        uses = np.zeros(self.size + 1)
        for places in self.batches(words):
            some = [words[i] for i in places]
            n = np.array([len(w) for w in some])
            row, start, end, piece = self.arcs(some)
            weight = probability[piece]
            ahead = np.zeros((len(some), n.max() + 1))
            behind = np.zeros_like(ahead)
            ahead[:, 0], behind[np.arange(len(some)), n] = 1, 1
            by_end, by_start = np.argsort(end, kind="stable"), np.argsort(-start, kind="stable")
            for at in np.split(by_end, np.flatnonzero(np.diff(end[by_end])) + 1):
                ahead[:, end[at[0]]] += np.bincount(row[at], ahead[row[at], start[at]] * weight[at], len(some))
            for at in np.split(by_start, np.flatnonzero(np.diff(start[by_start])) + 1):
                behind[:, start[at[0]]] += np.bincount(row[at], behind[row[at], end[at]] * weight[at], len(some))
            share = ahead[row, start] * weight * behind[row, end] / behind[row, 0] * counts[places][row]
            uses += np.bincount(piece, share, self.size + 1)
        return uses
