"""Cheapest edits that make a run of turns alternate: bidirectional Dijkstra over the edit lattice.

A node is (rows consumed, initial of the last kept turn); the initials of the kept turns must spell `(s?(ua)+)?`. Edges keep
(K), rerole (R) or delete (D) the next row, or insert (I) an empty turn. After any prefix one initial alone may follow but at
the start, so the letters say which role a reroled or inserted turn has.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from functools import lru_cache

Label = tuple[int, str]

FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
PRECEDES = {after: [state for state in FOLLOWS if after in FOLLOWS[state]] for after in "sua"}
STATES, ENDS = tuple(FOLLOWS), ("", "a")
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "."
LONGEST_CACHED = 64


def row_edits(initial: str, fault: str) -> list[tuple[str, int, str]]:
    """(letter, cost, initial after) of the edits of one row that leave a turn."""
    if fault in (BLANK, DUPLICATE):
        return []
    extra = CUT_OFF if fault == TRUNCATED else 0
    kept = [("K", extra, initial)] if initial in PRECEDES else []
    return kept + [("R", REROLE + extra, role) for role in "ua"]


def forward(initials: str, faults: str, at: int, state: str) -> Iterable[tuple[str, int, int, str]]:
    """(letter, cost, next rows consumed, next state) of the edges out of a node."""
    for role in FOLLOWS[state]:
        if role != "s":
            yield "I", INSERT, at, role
    if at < len(initials):
        yield "D", DELETE, at + 1, state
        for letter, cost, role in row_edits(initials[at], faults[at]):
            if role in FOLLOWS[state]:
                yield letter, cost, at + 1, role


def backward(initials: str, faults: str, at: int, state: str) -> Iterable[tuple[str, int, int, str]]:
    """(letter, cost, rows consumed before, state before) of the edges into a node."""
    if state and state != "s":
        for before in PRECEDES[state]:
            yield "I", INSERT, at, before
    if at:
        yield "D", DELETE, at - 1, state
        for letter, cost, role in row_edits(initials[at - 1], faults[at - 1]):
            if role == state:
                for before in PRECEDES[state]:
                    yield letter, cost, at - 1, before


class Search:
    """One direction of the search: open labels, settled labels and the heap.

    Edges that cost nothing lead to the next row, so nodes of equal cost are settled row by row, and a node's least audit
    stands when it is settled. Two audits of equal cost up to the same node are never the beginning of one another (they would
    differ by insertions alone, which cost), so the least parts make the least whole.
    """

    def __init__(self, edges, starts: Iterable[tuple[int, str]], way: int):
        self.edges, self.way = edges, way
        self.labels: dict[tuple[int, str], Label] = dict.fromkeys(starts, (0, ""))
        self.settled: set[tuple[int, str]] = set()
        self.heap = [(0, way * at, state) for at, state in self.labels]
        heapq.heapify(self.heap)

    def least(self) -> float:
        while self.heap and (self.way * self.heap[0][1], self.heap[0][2]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self, other: Search) -> Iterable[Label]:
        """Settles the nearest open node; yields the whole paths that cross to settled nodes of the other search there."""
        cost, place, state = heapq.heappop(self.heap)
        node = (self.way * place, state)
        self.settled.add(node)
        audit = self.labels[node][1]
        if node in other.settled:
            yield self.whole(self.labels[node], other.labels[node])
        for letter, more, at, after in self.edges(*node):
            new, there = (cost + more, audit + letter if self.way > 0 else letter + audit), (at, after)
            if there in other.settled:
                yield self.whole(new, other.labels[there])
            if there not in self.settled and (there not in self.labels or new < self.labels[there]):
                self.labels[there] = new
                heapq.heappush(self.heap, (new[0], self.way * at, after))

    def whole(self, own: Label, rest: Label) -> Label:
        return own[0] + rest[0], own[1] + rest[1] if self.way > 0 else rest[1] + own[1]


def search(initials: str, faults: str, entry: str, exits: tuple[str, ...]) -> Label | None:
    """(cost, least audit) of the cheapest paths from the state `entry` before the rows to one of `exits` after them."""
    n = len(initials)
    ahead = Search(lambda at, state: forward(initials, faults, at, state), [(0, entry)], 1)
    back = Search(lambda at, state: backward(initials, faults, at, state), [(n, state) for state in exits], -1)
    best: Label | None = None
    while (reach := ahead.least() + back.least()) != float("inf") and (best is None or reach <= best[0]):
        turn, other = (ahead, back) if ahead.least() <= back.least() else (back, ahead)
        for label in turn.settle(other):
            best = min(best or label, label)
    return best


_cached = lru_cache(maxsize=65_536)(search)


def cheapest(initials: str, faults: str, entry: str = "", exits: tuple[str, ...] = ENDS) -> Label | None:
    """`search`, which remembers short runs: most conversations share a few patterns."""
    return (_cached if len(initials) <= LONGEST_CACHED else search)(initials, faults, entry, exits)


def codes(audit: str, initials: str, state: str) -> tuple[list[str], str]:
    """Edits of each row and the state after them: K, D, u and a (reroled), U and A (inserted before the row).

    What is inserted after the last row goes with it.
    """
    out, run = [], ""
    for letter in audit:
        if letter in "RI":
            state = "a" if state == "u" else "u"
            run += state if letter == "R" else state.upper()
        else:
            run += letter
            state = initials[len(out)] if letter == "K" else state
        if letter != "I":
            out.append(run)
            run = ""
    if out:
        out[-1] += run
    return out, state
