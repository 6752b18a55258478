"""A grouping genetic algorithm for bin packing, on counts.

Items of one length are alike, so a solution is a count of bins for each pattern (the lengths a bin holds), and all work
depends on the number of patterns, not of items: a whole corpus is one table of at most `room` lengths. A gene is a bin.
"""

from __future__ import annotations

import random
from collections import Counter

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first
Solution = dict[Pattern, int]


def fill(pattern: Pattern) -> int:
    return sum(length * k for length, k in pattern)


def with_item(pattern: Pattern, length: int, k: int = 1) -> Pattern:
    held = dict(pattern)
    held[length] = held.get(length, 0) + k
    return tuple(sorted(held.items(), reverse=True))


def bins(solution: Solution) -> int:
    return sum(solution.values())


def fitness(solution: Solution, room: int) -> tuple[int, float]:
    """Fewer bins first; among equals, the more unevenly filled, as these are easier to improve."""
    return -bins(solution), sum(n * (fill(p) / room) ** 2 for p, n in solution.items())


def best_fit(solution: Solution, items: dict[int, int], room: int, order: list[int] | None = None) -> Solution:
    """Put items, longest first or in the order given, each into the fullest bin that takes it, else into a new one.

    Items of one length and bins of one free space move together.
    """
    space: dict[int, dict[Pattern, int]] = {}
    for p, n in solution.items():
        space.setdefault(room - fill(p), {})[p] = n
    for length in order or sorted(items, reverse=True):
        left = items.get(length, 0)
        free = length
        while left:
            while free <= room and not space.get(free):
                free += 1
            if free > room:
                per = min(room // length, left)
                new, rest = divmod(left, per)
                for k, n in ((per, new), (rest, 1 if rest else 0)):
                    if n:
                        p = ((length, k),)
                        at = space.setdefault(room - length * k, {})
                        at[p] = at.get(p, 0) + n
                break
            level = space[free]
            p, n = level.popitem()
            k = min(free // length, left)  # the fullest bin stays the fullest, so it takes all it can
            moved = min(n, left // k)
            if n > moved:
                level[p] = n - moved
            new = with_item(p, length, k)
            at = space.setdefault(free - length * k, {})
            at[new] = at.get(new, 0) + moved
            left -= moved * k
    return {p: n for level in space.values() for p, n in level.items() if n}


def crossover(one: Solution, other: Solution, items: dict[int, int], room: int, rng: random.Random) -> Solution:
    """Whole well-filled bins of `other` go into `one`; bins of `one` with items then held twice are dissolved, and what they
    held besides is put back by best fit."""
    share = rng.uniform(0.2, 0.8)
    good = [(p, n) for p, n in other.items() if fill(p) >= room * rng.choice((1.0, 0.99, 0.95))]
    child: Solution = {}
    for p, n in good:
        if taken := round(n * share) if n > 1 else int(rng.random() < share):
            child[p] = taken
    left = Counter(items)
    for p, n in child.items():
        for length, k in p:
            left[length] -= n * k
    for p, n in sorted(one.items(), key=lambda x: -fill(x[0])):
        if kept := min(n, *(left[length] // k for length, k in p)):
            child[p] = child.get(p, 0) + kept
            for length, k in p:
                left[length] -= kept * k
    return best_fit(child, {length: n for length, n in left.items() if n}, room)


def mutated(solution: Solution, room: int, rng: random.Random) -> Solution:
    """Dissolve the emptiest bins and some others, and put their items back by best fit."""
    child, loose = {}, Counter()
    floor = sorted(solution, key=fill)[:max(2, len(solution) // 20)]
    worst = set(floor)
    for p, n in solution.items():
        gone = n if p in worst else round(n * 0.5) if rng.random() < 0.1 else 0
        if n - gone:
            child[p] = n - gone
        for length, k in p:
            loose[length] += gone * k
    order = sorted((x for x, n in loose.items() if n), key=lambda x: -x * rng.uniform(0.85, 1.15))
    return best_fit(child, dict(loose), room, order)


def evolve(items: dict[int, int], room: int, elites: list[Solution], seed: int, generations: int = 8, population: int = 6) -> list[Solution]:
    """Some generations on one island; the best two solutions, best first."""
    rng = random.Random(seed)
    least = -(-sum(x * n for x, n in items.items()) // room)
    people = list(elites) or [best_fit({}, items, room)]
    while len(people) < population:
        people.append(best_fit({}, items, room, sorted(items, key=lambda x: -x * rng.uniform(0.9, 1.1))))
    people.sort(key=lambda s: fitness(s, room), reverse=True)
    for _ in range(generations):
        if bins(people[0]) == least:
            break
        one, other = rng.sample(people[:max(2, len(people) // 2 + 1)], 2)
        child = crossover(one, other, items, room, rng)
        people += [child, mutated(child if rng.random() < 0.5 else people[0], room, rng)]
        people = sorted(people, key=lambda s: fitness(s, room), reverse=True)[:population]
    return people[:2]
