"""Best-fit packing of tokenised documents into sequences of a fixed length, by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut into full pieces, the first of which may be shorter; all pieces are packed.
Pieces of one length are alike, so the islands (Spark tasks) evolve counts of bin patterns over the table of lengths, whose
size is bounded by the sequence length whatever the corpus. After each epoch every island's elite goes to the next island.
The best solution becomes ranges of ranks for each length, and every piece finds its place by its rank among pieces of its
length: ranks come from counts per part of the written pieces, never from gathering a length in one task.

Null texts are empty (the end id alone); repeated rows are packed each by itself; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallbars.llm.bin_genetics import Solution, bins, evolve, fitness
from squallbars.llm.common import running_base, vocabulary_file, written
from squallbars.llm.encoding import encoder, grouped


def token_pieces(docs: DataFrame, vocabulary: str, room: int = 1024, end_id: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, at): pieces, and each one's rank among those of its length in its part."""
    spec = vocabulary_file(docs.sparkSession, vocabulary)
    end = np.array([end_id], "<u4").tobytes()
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "at"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, part, seen = encoder(spec.value), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            row, piece, start, length, crc, rank, done = [], [], [], [], [], [], 0
            for some in grouped(batch.column("text").to_pylist()):
                for i, ids in enumerate(rules.encode_texts(some, end)):
                    n = len(ids) // 4
                    edges = [0, *range((n - 1) % room + 1, n + 1, room)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        row.append(done + i), piece.append(k), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a:4 * b])), rank.append(seen[b - a])
                        seen[b - a] += 1
                done += len(some)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank, pa.int64())], names)

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        cut, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, at long")


def island_solution(spark: SparkSession, items: dict[int, int], room: int, islands: int = 8, epochs: int = 3, seed: int = 7) -> Solution:
    """The best bins that the islands find for a table of lengths."""
    if not items:
        return {}
    least = -(-sum(x * n for x, n in items.items()) // room)
    elites: list[list[Solution]] = [[] for _ in range(islands)]
    for epoch in range(epochs):
        state = spark.sparkContext.broadcast((items, elites))

        def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for island in batch.column(0).to_pylist():
                    table, all_elites = state.value
                    guests = all_elites[island] + all_elites[island - 1][:1]
                    for s in evolve(table, room, guests, seed + 1000 * epoch + island):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([island]), pa.array([[[x for item in p for x in item] for p in s]], pa.list_(pa.list_(pa.int32()))), pa.array([list(s.values())], pa.list_(pa.int64()))],
                            ["island", "patterns", "counts"])

        found = spark.range(0, islands, 1, islands).mapInArrow(live, "island long, patterns array<array<int>>, counts array<long>").collect()
        elites = [[] for _ in range(islands)]
        for r in sorted(found, key=lambda r: r.island):
            elites[r.island].append({tuple(zip(p[::2], p[1::2], strict=True)): n for p, n in zip(r.patterns, r.counts, strict=True)})
        best = max((s for e in elites for s in e), key=lambda s: fitness(s, room))
        if bins(best) == least:
            break
    return best


def slots(solution: Solution) -> dict[int, np.ndarray]:
    """For each length its ranges of ranks: rows (first rank, first sequence, bins, offset of the first such piece)."""
    ranges: dict[int, list] = {}
    rank, sequence = Counter(), 0
    for pattern, n in sorted(solution.items(), reverse=True):
        offset = 0
        for length, k in pattern:
            ranges.setdefault(length, []).append((rank[length], sequence, n, offset))
            rank[length] += n * k
            offset += length * k
        sequence += n
    return {length: np.array(r, np.int64) for length, r in ranges.items()}


def pack(docs: DataFrame, vocabulary: str, room: int = 1024, end_id: int = 2, id: str = "doc_id", text: str = "text", islands: int = 8) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, vocabulary, room, end_id, id, text), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    items = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(slots(island_solution(spark, items, room, islands)))
    bases = running_base(counts, "part", "n", ["length"]).select("part", "length", "base")
    ranked = pieces.join(bases, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                here, table = np.flatnonzero(length == x), plan.value[int(x)]
                first, number, n, off = table[np.searchsorted(table[:, 0], rank[here], side="right") - 1].T
                turn, bin_ = np.divmod(rank[here] - first, n)
                sequence[here], offset[here] = number + bin_, off + turn * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kind = docs.schema[id].dataType.simpleString()
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id)
