"""Removal of byte strings that occur elsewhere, by a distributed sort of suffixes that keeps common prefixes.

1. Every window of `length` bytes has an anchor chosen by its content, so only suffixes at anchors are sorted. Anchors whose
   gram occurs once in the corpus are left out (none of their windows can occur twice), and anchors with the same bytes all
   around them are one place with several copies.
2. The text right of each remaining place and the reversed text left of it are sorted: tasks sort what they hold and write
   front-coded runs, which are exchanged by range; each range merges its runs with a loser tree that never compares again
   what two strings are known to share. Equal strings may spread over ranges.
3. Neighbours' common prefixes give a tree of classes for each side: a class holds all strings that share its depth. Ranges
   know the classes that reach beyond them from a summary of each range (its first and last string and how common prefixes
   fall off from both).
4. A window at offset o left of a place occurs elsewhere if another place is in the same class at depth o on the left and
   `length - o` on the right. A place answers for the windows that chose it alone: equal windows choose alike. Over a run of
   offsets the right class is constant, and a left class that two places of it share covers all smaller offsets of the run.
   Right classes that lie within a range are settled there, among the places of the range. Pairs of classes that reach beyond
   are counted by a partial sum, whatever the size of a class; left classes that lie between multiples of `COARSE` are counted
   only where coarse ones leave them open.

Matches never cross documents; overlapping matches count. Null texts are empty; equal texts are treated once and their rows
get the same result; an empty table gives no rows; columns other than `id` and `text` are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallbars.llm.common import release, written
from squallbars.llm.ngram_join import runs as sorted_runs
from squallbars.llm.suffix_anchors import GRAM, Sums, anchors
from squallbars.llm.suffix_runs import encode_run, merge_runs, shared

PER_RANGE = 40_000
MOST_RANGES = 4_096
RUN = 20_000
COARSE = 16
SAMPLE = 1024
GROUP = 1 << 18


def context_id() -> Column:
    """The number of a context, from the digests of its gram and of all around it."""
    return F.xxhash64("gram", "around", "around2")


def with_key(docs: DataFrame) -> DataFrame:
    """`docs` with a 64-bit digest `key` and the bytes `n` of each text (null: empty), which tell texts apart."""
    whole = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return whole.withColumn("key", F.xxhash64("text")).withColumn("n", F.octet_length("text").cast("long"))


def byte_groups(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends): texts as they lie one behind the other, cut into groups of about `size` bytes."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw, row = np.frombuffer(texts.buffers()[2] or b"", np.uint8), 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(ends, ends[row] + size)))
        upto = min(upto, len(texts))
        yield row, raw[ends[row]:ends[upto]], ends[row + 1:upto + 1] - ends[row]
        row = upto


def text_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(key, n, place, low, high, gram, around, around2, sample): anchors of every text, with digests of what surrounds them.

    The windows that choose an anchor begin `low` to `high` bytes before it. Where the digest of what surrounds it is a multiple
    of `SAMPLE`, `sample` has the two strings to sort, from which ranges are chosen: not by gram, as a frequent one has many contexts.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for row, raw, ends in byte_groups(batch.column("text"), GROUP):
                sums, more = Sums(raw, 0), Sums(raw, 1)
                place, first, last, gram = anchors(raw, length, sums, ends)
                text = np.searchsorted(ends, place, side="right")
                end, begin = ends[text], (ends - np.diff(ends, prepend=0))[text]
                start, stop = np.maximum(begin, place - (length - GRAM)), np.minimum(end, place + length)
                edge = ((place - start) << 32 | (stop - place)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                around, sample = sums.digest(start, stop) ^ edge, [None] * len(place)
                for k in np.flatnonzero(around % np.uint64(SAMPLE) == 0).tolist():
                    sample[k] = list(context(raw[start[k]:stop[k]].tobytes(), int(place[k] - start[k]), length))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row + text]), pa.array(end - begin), pa.array(place - begin), pa.array((place - last).astype(np.int32)), pa.array((place - first).astype(np.int32)),
                     pa.array(gram.astype(np.int64)), pa.array(around.astype(np.int64)), pa.array(more.digest(start, stop).astype(np.int64)),
                     pa.array(sample, pa.list_(pa.binary()))],
                    ["key", "n", "place", "low", "high", "gram", "around", "around2", "sample"])

    texts = with_key(docs.select("text")).filter(F.col("n") >= length).select("key", "text")
    return texts.mapInArrow(find, "key long, n long, place long, low int, high int, gram long, around long, around2 long, sample array<binary>")


def context(raw: bytes, place: int, length: int) -> tuple[bytes, bytes]:
    """What is right of a place, and what is left of it reversed, each behind the mark of its side."""
    return b"R" + raw[place:place + length], b"L" + raw[max(0, place - (length - GRAM)):place][::-1]


def cuts(strings: list[tuple[bytes, int]], ranges: int) -> list[tuple[bytes, int]]:
    """Where ranges begin, from drawn strings in order: the shortest string that tells a drawn one from the one before.

    A cut moves by a range's share at most to where the right sides next to it share no gram, or as little as can be had, so
    right classes lie within a range unless they outgrow it. Cuts through left classes cost nothing and do not move.
    """
    common = [0, *(shared(a[0], b[0]) for a, b in zip(strings[:-1], strings[1:], strict=True))]
    out, share = set(), len(strings) / ranges
    for k in range(1, ranges):
        near = range(max(1, round((k - 1) * share)), min(len(strings), round((k + 1) * share) + 1))
        if near:
            at = min(near, key=lambda i: (strings[i][0][:1] == b"R" and max(common[i], GRAM), abs(i - k * share)))
            string, number = strings[at]
            out.add((string[:common[at] + 1], -1 << 63) if common[at] < len(string) else (string, number))
    return sorted(out)


def context_runs(docs: DataFrame, places: DataFrame, length: int, splitters: list[tuple[bytes, int]]) -> DataFrame:
    """Front-coded sorted runs (range, run) of the contexts of places.

    `places` has (key, n, spots): the ids and places of a text's contexts.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
        for batch in batches:
            for row, raw, ends in byte_groups(batch.column("text"), 8 * GROUP):
                start = 0
                for end, spots in zip(ends.tolist(), batch.column("spots").slice(row, len(ends)).to_pylist(), strict=True):
                    text, start = raw[start:end].tobytes(), end
                    for spot in spots:
                        for string in context(text, spot["place"], length):
                            yield string, spot["id"]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple[bytes, int]] = []

        def out() -> pa.RecordBatch:
            held.sort()
            edges = [0, *(bisect_left(held, s) for s in splitters), len(held)]
            cut = [(k, held[a:b]) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([encode_run([s for s, _ in c], [i for _, i in c]) for _, c in cut], pa.binary())], ["range", "run"])

        for item in contexts(batches):
            held.append(item)
            if len(held) >= RUN:
                yield out()
        if held:
            yield out()

    texts = with_key(docs.select("text")).join(places, ["key", "n"]).dropDuplicates(["key", "n"]).select("text", "spots")
    return texts.mapInArrow(sort, "range int, run binary")


def merged(exchanged: DataFrame) -> DataFrame:
    """One row for each range: its numbers in order, shared prefixes of neighbours, its first and last string."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["range"]):
            ids, common, first, last, lefts = [], [], None, b"", 0
            for last, c, number in merge_runs(table.column("run").to_pylist()):
                first = last if first is None else first
                lefts += last[:1] == b"L"
                ids.append(number)
                common.append(c)
            down, up = falling(common[1:]), stack(common)
            yield pa.RecordBatch.from_arrays(
                [table.column("range").slice(0, 1).combine_chunks(), pa.array([ids], pa.list_(pa.int64())), pa.array([common], pa.list_(pa.int32())), pa.array([first], pa.binary()), pa.array([last], pa.binary()),
                 pa.array([down], pa.list_(pa.int32())), pa.array([[d for d, _ in up]], pa.list_(pa.int32())), pa.array([[s for _, s in up]], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([lefts], pa.int64())],
                ["range", "ids", "common", "first", "last", "falling", "depths", "starts", "size", "lefts"])

    return exchanged.repartition("range").sortWithinPartitions("range").mapInArrow(
        merge, "range int, ids array<long>, common array<int>, first binary, last binary, falling array<int>, depths array<int>, starts array<long>, size long, lefts long")


def falling(common: list[int]) -> list[int]:
    """How a first string's shared prefix falls off along the strings after it: the distinct running minima."""
    out: list[int] = []
    for c in common:
        if not out or c < out[-1]:
            out.append(c)
        if not c:
            break
    return out


def push(open_: list[tuple[int, int]], depth: int, start: int) -> None:
    """Take a neighbour's shared prefix into the stack of open classes (depth, rank of the first string)."""
    while open_ and open_[-1][0] > depth:
        start = open_.pop()[1]
    if not open_ or open_[-1][0] < depth:
        open_.append((depth, start))


def stack(common: list[int]) -> list[tuple[int, int]]:
    """Open classes at the end of a range by its own strings alone, starts counted from its first."""
    open_: list[tuple[int, int]] = []
    for i in range(1, len(common)):
        push(open_, common[i], i - 1)
    return open_


def carried(summaries: list) -> dict[int, tuple[int, list[tuple[int, int]], int, list[int]]]:
    """For each range: the rank of its first string, the classes open before it, the prefix shared with the string before, and
    how its last string's shared prefix falls off over the ranges after it. A row for each range is all that is gathered."""
    out, rank, open_ = {}, 0, []
    for i, s in enumerate(summaries):
        before = shared(summaries[i - 1]["last"], s["first"]) if i else 0
        out[s["range"]] = [rank, list(open_), before, []]
        if i:
            push(open_, before, rank - 1)
        for depth, start in zip(s["depths"], s["starts"], strict=True):
            push(open_, depth, rank + start)
        rank += s["size"]
    tail: list[int] = []
    for i in range(len(summaries) - 1, -1, -1):
        out[summaries[i]["range"]][3] = tail
        if i:
            edge = shared(summaries[i - 1]["last"], summaries[i]["first"])
            inner = summaries[i]["falling"]
            beyond = [min(inner[-1], t) for t in tail] if inner else tail
            tail = falling([edge, *(min(edge, x) for x in [*inner, *beyond])])
    return {k: tuple(v) for k, v in out.items()}


def class_chains(order: DataFrame, carry, is_right: bool) -> DataFrame:
    """(id, range, depths, starts, inside): for each string of a side its classes, deepest first, of which the first `inside`
    lie within the string's range; a class is its depth and its first rank."""
    least = GRAM if is_right else 1

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in range(batch.num_rows):
                number, lefts = batch.column("range")[row].as_py(), batch.column("lefts")[row].as_py()
                rank, open_, before, after = carry.value[number]
                ids, common = np.asarray(batch.column("ids")[row].values), batch.column("common")[row].values.to_pylist()
                leaf, nodes = class_tree(rank, open_, [before, *common[1:]], after)
                known: dict[int, tuple[list[int], list[int], int]] = {}
                start, end = (lefts, len(ids)) if is_right else (0, lefts)
                for at in range(start, end, 20_000):
                    upto, lists = min(end, at + 20_000), []
                    for x in leaf[at:upto]:
                        if x not in known:
                            known[x] = _chain(nodes, x, least)
                        lists.append(known[x])
                    ends = pa.array(np.cumsum([0, *(len(d) for d, _, _ in lists)]), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at:upto]), pa.array(np.full(upto - at, number), pa.int32()), pa.ListArray.from_arrays(ends, pa.array([x for d, _, _ in lists for x in d], pa.int32())),
                         pa.ListArray.from_arrays(ends, pa.array([x for _, s, _ in lists for x in s], pa.int64())), pa.array([k for _, _, k in lists], pa.int32())],
                        ["id", "range", "depths", "starts", "inside"])

    side = F.col("lefts") < F.col("size") if is_right else F.col("lefts") > 0
    return order.filter(side).select("range", "ids", "common", "lefts").mapInArrow(chains, "id long, range int, depths array<int>, starts array<long>, inside int")


def class_tree(rank: int, open_: list[tuple[int, int]], common: list[int], after: list[int]) -> tuple[list[int], list[list[int]]]:
    """The deepest class of each string of a range and all classes as [depth, first rank, parent, within the range].

    `common[0]` is shared with the string before the range, `after` falls off behind its last.
    """
    nodes: list[list[int]] = [[0, 0, -1]]
    path = [0]
    for depth, start in open_:
        if depth:
            nodes.append([depth, start, path[-1]])
            path.append(len(nodes) - 1)

    def step(depth: int, start: int) -> None:
        below = None
        while nodes[path[-1]][0] > depth:
            below = path.pop()
            start = nodes[below][1]
            nodes[below][2] = path[-1]
        if nodes[path[-1]][0] < depth:
            nodes.append([depth, start, path[-1]])
            path.append(len(nodes) - 1)
        if below is not None:
            nodes[below][2] = path[-1]

    leaf = []
    for i, depth in enumerate(common):
        step(depth, rank + i - 1)
        nearest = common[i + 1] if i + 1 < len(common) else after[0] if after else 0
        if nearest > depth:
            leaf.append(-1)  # the class that the next string opens
        else:
            leaf.append(path[-1])
        if i and leaf[i - 1] == -1:
            leaf[i - 1] = path[-1]
    inner, beyond = len(nodes), {k for k in path if after and nodes[k][0] <= after[0]}
    for depth in after:
        step(depth, rank + len(common) - 1)
        if leaf and leaf[-1] == -1:
            leaf[-1] = path[-1]
    for k, node in enumerate(nodes):
        node.append(k < inner and k not in beyond and node[1] >= rank)
    return leaf, nodes


def _chain(nodes: list[list[int]], at: int, least: int) -> tuple[list[int], list[int], int]:
    """Depths (without the side's mark, `least` or more) and first ranks of a class and those around it, how many lie inside."""
    depths, starts, inside = [], [], 0
    while at > 0 and nodes[at][0] > least:
        depths.append(nodes[at][0] - 1), starts.append(nodes[at][1])
        inside += nodes[at][3]
        at = nodes[at][2]
    return depths, starts, inside


def class_pairs(right: list[tuple[int, int]], left: list[tuple[int, int]], length: int, least: int, most: int) -> list[tuple]:
    """Pairs of a right class and a coarse left class of a place: (right depth, right start, left depth, left start, from, to, finer).

    Only offsets from `least` to `most` count, those of the windows that chose the place: places that share a pair agree on them.
    A right class of depth d holds for offsets from `length - d` on, up to where a deeper one is not enough; inside that
    run, a left class holds for offsets up to its depth, so a pair that two places share covers all offsets `from`..`to`.
    Left classes whose own offsets include no multiple of `COARSE` are `finer`: (depth, start, to), kept with the coarse class
    above them. What is coarse depends on the two classes alone, so all places of a pair agree. The class of all (depth 0)
    comes first.
    """
    out = []
    for i, (d, s) in enumerate(right):
        low, high = max(least, length - d), min(most, length - (right[i + 1][0] if i + 1 < len(right) else 0) - 1)
        rows, above = [[d, s, 0, 0, low, 0 if low == 0 <= high else -1, []]], 0
        for e, t in reversed(left):
            if above >= high:
                break
            top = min(e, high)
            if top >= max(low, 1):
                if top // COARSE * COARSE > max(above, low - 1):
                    rows.append([d, s, e, t, low, top, []])
                else:
                    rows[-1][-1].append({"d": e, "s": t, "to": top})
            above = e
        if low <= high and (len(rows) > 1 or rows[0][-1] or rows[0][-2] == 0):
            out.extend(map(tuple, rows))
    return out


def settled_offsets(right: tuple[np.ndarray, ...], left: tuple[np.ndarray, ...], least: np.ndarray, most: np.ndarray, inside: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, from, to): runs of offsets that the right classes inside a range settle, from the rows of all its places.

    A side is (depths, starts, ends of each row's classes, deepest first). A pair of classes covers the offsets of the right
    class's run up to the left class's depth; it is shared if two rows have it.
    """
    (rd, rs, r_ends), (ld, ls, l_ends) = right, left
    many = np.diff(r_ends)
    row = np.repeat(np.arange(len(many)), many)
    around = np.append(rd[1:], 0)
    around[r_ends[1:][many > 0] - 1] = 0
    low, high = np.maximum(length - rd, least[row]), np.minimum(length - around - 1, most[row])
    run = np.flatnonzero((low <= high) & (np.arange(len(rd)) - r_ends[row] < inside[row]))
    row, low, high, code = row[run], low[run], high[run], rs[run] << 10 | rd[run]
    # Left classes of each row, shallow ones first, by row and depth.
    count = np.diff(l_ends)
    owner = np.repeat(np.arange(len(count)), count)
    turned = l_ends[owner] + l_ends[owner + 1] - 1 - np.arange(len(ld))
    depth, left_code = ld[turned], ls[turned] << 10 | ld[turned]
    place = owner * (length + 1) + depth
    first = np.searchsorted(place, row * (length + 1) + np.maximum(low, 1))
    last = np.minimum(np.searchsorted(place, row * (length + 1) + np.maximum(high, 1)) + 1, l_ends[row + 1])
    width = np.where(high > 0, np.maximum(last - first, 0), 0)
    to = np.where(low == 0, 0, -1)  # a right class has two rows at least
    # Runs of one class together, some classes at a time.
    if not len(row):
        return row, low, to
    order = np.argsort(code, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(code[order], prepend=-1)), len(order))
    sizes = np.add.reduceat(width[order], edges[:-1])
    parts = np.flatnonzero(np.diff(np.cumsum(sizes) // 1_000_000, prepend=-1))
    for a, b in zip(parts, np.append(parts[1:], len(sizes)), strict=True):
        some = order[edges[a]:edges[b]]
        some = some[width[some] > 0]
        if not len(some):
            continue
        begin = np.cumsum(width[some]) - width[some]
        at = np.repeat(first[some] - begin, width[some]) + np.arange(int(width[some].sum()))
        kind, by_left = np.unique(left_code[at], return_inverse=True)
        pair = np.repeat(np.searchsorted(code[order[edges[a:b]]], code[some]), width[some]) * len(kind) + by_left
        _, which, times = np.unique(pair, return_inverse=True, return_counts=True)
        top = np.where(times[which] > 1, np.minimum(depth[at], np.repeat(high[some], width[some])), -1)
        to[some] = np.maximum(to[some], np.maximum.reduceat(top, begin))
    found = to >= low
    return row[found], low[found], to[found]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, one behind the other, and where each row's begin."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0]:ends[-1]].astype(np.int64), ends - ends[0]


def repeated_offsets(places: DataFrame, rights: DataFrame, lefts: DataFrame, length: int) -> DataFrame:
    """(id, from, to): runs of offsets whose windows at a place occur at another place as well.

    Right classes inside a range are settled there. Of those that reach beyond, coarse pairs are counted first. A place's
    deepest shared coarse class leaves open only the finer classes below it; these are counted among all places of that pair.
    """
    # The planner only guesses the size of what Python returns; chains are many times their strings, so none is broadcast.
    both = (rights.select("id", "range", F.col("depths").alias("rd"), F.col("starts").alias("rs"), "inside").hint("merge")
            .join(lefts.select("id", F.col("depths").alias("ld"), F.col("starts").alias("ls")), "id").join(places, "id"))
    finer = pa.list_(pa.struct([("d", pa.int32()), ("s", pa.int64()), ("to", pa.int32())]))
    kinds = {"id": pa.int64(), "rd": pa.int32(), "rs": pa.int64(), "ld": pa.int32(), "ls": pa.int64(), "from": pa.int32(), "to": pa.int32(), "finer": finer}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in sorted_runs(batches, ["range"]):
            table = table.combine_chunks()
            column = lambda c: table.column(c).combine_chunks()
            ids, least, most, inside = (column(c).to_numpy().astype(np.int64) for c in ("id", "low", "high", "inside"))
            (rd, ends), (rs, _), (ld, l_ends), (ls, _) = (_lists(column(c)) for c in ("rd", "rs", "ld", "ls"))
            row, low, to = settled_offsets((rd, rs, ends), (ld, ls, l_ends), least, most, inside, length)
            fixed = {"id": pa.array(ids[row]), "from": pa.array(low, pa.int32()), "to": pa.array(to, pa.int32())}
            yield pa.RecordBatch.from_arrays([fixed[c] if c in fixed else pa.nulls(len(row), kind) for c, kind in kinds.items()], list(kinds))
            out: list[tuple] = []
            for k in np.flatnonzero(np.diff(ends) > inside).tolist():
                right, left = (list(zip(d[a:b].tolist(), s[a:b].tolist(), strict=True)) for d, s, a, b in ((rd, rs, ends[k] + inside[k], ends[k + 1]), (ld, ls, l_ends[k], l_ends[k + 1])))
                out.extend((int(ids[k]), *f) for f in class_pairs(right, left, length, int(least[k]), int(most[k])))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds.values())], list(kinds))
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    found = both.repartition("range").sortWithinPartitions("range").mapInArrow(
        pieces, "id long, rd int, rs long, ld int, ls long, `from` int, `to` int, finer array<struct<d:int,s:long,to:int>>")
    found = written(found.select("id", F.col("rd").isNull().alias("settled"), F.xxhash64("rd", "rs").alias("right"), F.xxhash64("rd", "rs", "ld", "ls").alias("pair"), "ld", "from", "to",
                                 (F.size("finer") > 0).alias("open"), "finer"), "class-pairs", compression="zstd")
    settled, found = found.filter("settled").select("id", "from", "to"), found.filter("not settled").drop("settled")
    coarse = found.drop("finer").join(repeated(found, "pair"), "pair")
    deepest = coarse.groupBy("id", "right").agg(F.max(F.struct("ld", "pair", "from", "to", "open")).alias("x")).select("id", "x.*")
    deepest = written(deepest, "deepest-pairs", compression="zstd")
    open_ = deepest.filter("open").select("pair").distinct()
    fine = (found.filter("open").join(open_, "pair").select("id", "right", "from", F.explode("finer").alias("f"))
            .select("id", F.xxhash64("right", "f.d", "f.s").alias("pair"), "from", F.col("f.to").alias("to")))
    fine = written(fine, "fine-pairs", compression="zstd")
    both_kinds = deepest.select("id", "from", "to").unionByName(fine.join(repeated(fine, "pair"), "pair").select("id", "from", "to")).unionByName(settled)
    return both_kinds.filter(F.col("to") >= F.col("from")).groupBy("id", "from").agg(F.max("to").alias("to"))


def repeated(rows: DataFrame, column: str) -> DataFrame:
    """The values that `column` has twice or more.

    Written, so that a join with them is not fused with the count and adaptive execution can split a frequent value's rows.
    """
    return written(rows.groupBy(column).agg(F.count("*").alias("_n")).filter("_n > 1").select(column), "repeated")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(key, n, spans): for each text with repeats the byte spans covered by strings that occur elsewhere."""
    spark = docs.sparkSession
    found = written(text_anchors(docs, length), "anchors", compression="zstd")
    some = written(found.join(repeated(found, "gram"), "gram"), "candidates", compression="zstd")
    contexts = some.groupBy("gram", "around", "around2").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("key", "n", "place", "low", "high")))
    # Grams with one context are settled: its copies alone repeat. Others are sorted.
    contexts = written(contexts.withColumn("id", context_id()), "contexts")
    sorted_ones = written(contexts.join(repeated(contexts, "gram"), "gram").select("id", "key", "n", "place", "low", "high"), "sorted")
    spots = written(sorted_ones.groupBy("key", "n").agg(F.collect_list(F.struct("id", "place")).alias("spots"), F.count("*").alias("m")), "spots")
    total = 2 * (spots.agg(F.sum("m").alias("m")).first().m or 0)
    offsets = contexts.select("id", F.col("low").alias("from"), F.col("high").alias("to")).limit(0)
    if total:
        ranges = min(MOST_RANGES, -(-total // PER_RANGE))
        # Ranges are cut by contexts that are sorted, each drawn once whatever its copies, 64 strings a range at most.
        chance = F.shiftrightunsigned(F.xxhash64("around", "around2"), 12) / float(1 << 52)
        drawn = some.filter(F.col("sample").isNotNull() & (chance < ranges * 64 * SAMPLE / total)).select(context_id().alias("id"), "sample")
        drawn = drawn.dropDuplicates(["id"]).join(sorted_ones.select("id"), "id").collect() if ranges > 1 else ()
        splitters = cuts(sorted({(bytes(x), r.id) for r in drawn for x in r["sample"]}), ranges)
        order = written(merged(context_runs(docs, spots.drop("m"), length, splitters)), "order", compression="zstd")
        summaries = [r.asDict() for r in order.drop("ids", "common").orderBy("range").collect()]
        carry = spark.sparkContext.broadcast(carried(summaries))
        offsets = repeated_offsets(sorted_ones.select("id", "low", "high"), class_chains(order, carry, True), class_chains(order, carry, False), length)
    whole = contexts.filter("copies > 1").select("id", F.col("low").alias("from"), F.col("high").alias("to"))
    runs = written(offsets.unionByName(whole), "offsets")
    places = some.withColumn("id", context_id()).select("id", "key", "n", "place")
    spans = (places.join(runs, "id")
             .select("key", "n", F.greatest(F.col("place") - F.col("to"), F.lit(0)).alias("a"), F.least(F.col("place") - F.col("from") + length, "n").alias("b"))
             .filter(F.col("b") - F.col("a") >= length))
    return written(spans.groupBy("key", "n").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, length: int = 400, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) of every row: the maximal spans of bytes removed and the bytes that are left."""
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = with_key(docs).join(repeated_spans(docs.select("text"), length), ["key", "n"], "left").select("id", "text", "spans")
    kind = docs.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row, raw, ends in byte_groups(batch.column("text"), 8 * GROUP):
                size, removed, kept, whole, start = [], [], [], raw.tobytes(), 0
                for end, found in zip(ends.tolist(), batch.column("spans").slice(row, len(ends)).to_pylist(), strict=True):
                    at, joined, left = start, [], []
                    for s in sorted((s["a"], s["b"]) for s in found or ()):
                        if joined and s[0] <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], s[1])
                        else:
                            joined.append(list(s))
                    for a, b in joined:
                        left.append(whole[at:start + a])
                        at = start + b
                    size.append(end - start), removed.append([{"start": a, "end": b} for a, b in joined]), kept.append(b"".join([*left, whole[at:end]]))
                    start = end
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(ends)), pa.array(size, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(cut, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id)
