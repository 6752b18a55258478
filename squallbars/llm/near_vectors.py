"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one kept of each group.

Cells are fitted on a bounded sample (`per_cell_fit` vectors for each cell, chosen by hash). Every vector belongs to its
nearest centroid's cell and visits each cell whose border (the hyperplane between both centroids) is within
sqrt(2 - 2 * threshold) / 2. Two vectors within the threshold are at most twice that apart, so one of them is as near to the
border between their cells, and visits: no pair is lost, in any number of dimensions. A cell is not visited where its
farthest member cannot be within the threshold. Cells of more than `block` vectors are split into blocks, and pairs of blocks
are compared as matrix products. Only counts and one edge for each linked vector leave a pair of blocks, never all its pairs.

Equal vectors are collapsed to one with a multiplicity before. Vectors that are null, empty, all zero or hold null or
non-finite components link with nothing and are kept; shorter vectors compare as if zeros followed. Repeated rows count as
vectors of their own; an empty table gives no rows; labels and other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallbars.llm.common import written
from squallbars.llm.components import components


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    """Unit vectors, padded with zeros."""
    flat, ends = np.asarray(column.flatten(), np.float64), np.asarray(column.offsets)
    ends = ends - ends[0]
    n = np.diff(ends)
    out = np.zeros((len(n), wide))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(ends[:-1], n)] = flat
    out /= np.abs(out).max(1, keepdims=True)  # no overflow in the squares
    return out / np.linalg.norm(out, axis=1, keepdims=True)


ROUNDING = 1e-7


def visits(unit: np.ndarray, centroids: np.ndarray, home: np.ndarray, margin: float, least: np.ndarray) -> np.ndarray:
    """Which cells besides its own each vector visits; `least` is the cosine with the centroid from which a visit can find one."""
    near = unit @ centroids.T
    gap = near[np.arange(len(unit)), home][:, None] - near
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centroids[home] @ centroids.T)))
    inside = (gap <= margin * apart + ROUNDING) & (near >= least - ROUNDING)
    inside[np.arange(len(unit)), home] = False
    return inside


def fit_cells(vectors: DataFrame, cells: int, wide: int, per_cell_fit: int = 64, rounds: int = 6) -> np.ndarray:
    """Centroids by spherical k-means over a hashed sample; each round sums vectors by cell inside every task."""
    spark = vectors.sparkSession
    total = max(1, vectors.count())
    chance = F.shiftrightunsigned(F.xxhash64("id", F.lit("fit")), 12) / float(1 << 52)
    sample = written(vectors.filter(chance < cells * per_cell_fit / total).select("id", "embedding"), "fit")
    first = sample.orderBy(F.xxhash64("id", F.lit("first"))).limit(cells).select("embedding").toArrow().column(0).combine_chunks()
    if not len(first):
        return np.zeros((0, wide))
    centroids = _matrix(first, wide)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast(centroids)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(state.value)
            for batch in batches:
                unit = _matrix(batch.column("embedding"), wide)
                np.add.at(sums, (unit @ state.value.T).argmax(1), unit)
            full = np.flatnonzero(np.abs(sums).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(list(sums[full]), pa.list_(pa.float64()))], ["cell", "total"])

        parts = sample.mapInArrow(add, "cell int, total array<double>").select("cell", F.posexplode("total")).groupBy("cell", "pos").agg(F.sum("col").alias("x")).toPandas()
        sums = np.zeros_like(centroids)
        sums[parts["cell"], parts["pos"]] = parts["x"]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    return centroids


def linked_roots(links: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name that each row of a symmetric link matrix reaches."""
    order = np.argsort(names)
    at = np.empty(len(names), np.int32)
    at[order] = np.arange(len(names), dtype=np.int32)
    rows = np.flatnonzero(links.any(1))
    while True:
        lower = at.copy()
        for k in range(0, len(rows), 512):
            some = rows[k:k + 512]
            lower[some] = np.minimum(at[some], np.where(links[some], at[None, :], len(names)).min(1))
        if (lower == at).all():
            return names[order][at]
        at = lower


def vector_groups(rows: DataFrame, threshold: float = 0.95, id: str = "vec_id", embedding: str = "embedding",
                  cell_size: int = 512, most_cells: int = 16_384, block: int = 2048, reach: float = 1.0) -> DataFrame:
    """(id, n_links, component_id, kept) of every row. A `reach` over 1 widens the margin, which finds no more pairs."""
    spark = rows.sparkSession
    rows = rows.select(F.col(id).cast("long").alias("id"), F.col(embedding).alias("embedding"))
    number = rows.schema["embedding"].dataType.elementType.simpleString()
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # -0.0 equals 0.0 in every comparison, so one form stands for both.
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(number)).otherwise(x))
    marked = rows.withColumn("embedding", F.when(usable, plain))
    classes = written(marked.filter(F.col("embedding").isNotNull()).groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")
    shape = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("wide")).first()
    wide = shape.wide or 1
    centroids = fit_cells(classes, max(1, min(most_cells, math.ceil(shape.n / cell_size))), wide)
    margin = max(1.0, reach) * math.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    state = spark.sparkContext.broadcast(centroids)
    step = max(16, min(1024, (1 << 22) // max(1, len(centroids))))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                near = _matrix(some.column("embedding"), wide) @ state.value.T
                yield pa.RecordBatch.from_arrays([pa.array(near.argmax(1), pa.int32()), pa.array(near.max(1)), *(some.column(c) for c in ("id", "copies", "embedding"))],
                                                 ["home", "near", "id", "copies", "embedding"])

    vector = f"id long, copies long, embedding array<{number}>"
    settled = written(classes.select("id", "copies", "embedding").mapInArrow(settle, f"home int, near double, {vector}"), "settled")
    cells = settled.groupBy("home").agg(F.count("*").alias("n"), F.min("near").alias("near")).toPandas()
    homes, least = np.zeros(len(centroids), np.int64), np.full(len(centroids), 2.0)
    homes[cells["home"]] = cells["n"]
    widest = np.arccos(np.clip(cells["near"], -1, 1)) + math.acos(min(1.0, max(-1.0, threshold)))
    least[cells["home"]] = np.cos(np.minimum(math.pi, widest))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                home = np.asarray(some.column("home"))
                yield some, home, *np.nonzero(visits(_matrix(some.column("embedding"), wide), state.value, home, margin, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(state.value), np.int64)
        for _, _, _, cell in seen(batches):
            n += np.bincount(cell, minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], ["cell", "n"])

    visitors = np.zeros(len(centroids), np.int64)
    guests = settled.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    visitors[guests["cell"]] = guests["n"]
    # The first blocks of a cell are of those at home in it, the others of its visitors.
    own_blocks, visitor_blocks = -(-homes // block), -(-visitors // block)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, home, row, cell in seen(batches):
            n = len(home)
            goes = np.split(cell, np.cumsum(np.bincount(row, minlength=n))[:-1])
            row, cell = np.concatenate([np.arange(n), row]), np.concatenate([home, cell])
            at_home = np.arange(len(row)) < n
            mixed = (np.asarray(some.column("id")).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)[row]
            own = np.where(at_home, mixed % np.maximum(1, own_blocks[cell]), own_blocks[cell] + mixed % np.maximum(1, visitor_blocks[cell]))
            times = own_blocks[cell] + np.where(at_home, visitor_blocks[cell], 0)
            ends = np.cumsum(times)
            for lo in range(0, int(ends[-1]), 8192):
                k = np.arange(lo, min(lo + 8192, int(ends[-1])))
                at = np.searchsorted(ends, k, "right")
                other = k - (ends[at] - times[at])
                to_visitors = at_home[at] & (other >= own_blocks[cell[at]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[at], pa.int32()), *(pa.array(x, pa.int32()) for x in (np.minimum(own[at], other), np.maximum(own[at], other), own[at], home[row[at]])),
                     pa.array([goes[r] if v else None for r, v in zip(row[at], to_visitors, strict=True)], pa.list_(pa.int32())),
                     *(some.column(c).take(pa.array(row[at])) for c in ("id", "copies", "embedding"))],
                    ["cell", "a", "b", "block", "home", "goes", "id", "copies", "embedding"])

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cell, a, b = (table.column(c)[0].as_py() for c in ("cell", "a", "b"))
        own = np.asarray(table.column("block"))
        ids, copies, home = (np.asarray(table.column(c)) for c in ("id", "copies", "home"))
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        unit = _matrix(table.column("embedding").combine_chunks(), wide)
        got = unit[left] @ unit[right].T >= threshold
        if a == b:
            got |= got.T
            np.fill_diagonal(got, False)
        i, j = np.nonzero(got)
        i, j = left[i], right[j]
        if b >= own_blocks[cell]:
            # Where both visit, the pair is counted in the lesser of the two cells.
            goes = table.column("goes").combine_chunks()
            both = np.repeat(np.arange(len(ids)), np.diff(np.asarray(goes.offsets))) * len(state.value) + np.asarray(goes.flatten())
            here = (cell < home[j]) | ~np.isin(i * len(state.value) + home[j], both)
            i, j = i[here], j[here]
        n = np.bincount(i, copies[j], len(ids))
        if a != b:
            n += np.bincount(j, copies[i], len(ids))
        some = np.flatnonzero(n)
        links = np.zeros((len(some), len(some)), bool)
        i, j = np.searchsorted(some, i), np.searchsorted(some, j)
        links[i, j] = links[j, i] = True
        return pa.table({"id": pa.array(ids[some], pa.int64()), "links": pa.array(n[some].astype(np.int64)), "root": pa.array(linked_roots(links, ids[some]), pa.int64())})

    placed = settled.mapInArrow(place, f"cell int, a int, b int, block int, home int, goes array<int>, {vector}")
    found = written(placed.groupBy("cell", "a", "b").applyInArrow(compare, "id long, links long, root long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    results = (classes.select("embedding", F.col("id").alias("_first"), "copies").join(counts.withColumnRenamed("id", "_c"), F.col("_first") == F.col("_c"), "left")
               .join(parts, F.col("_first") == F.col("node"), "left")
               .select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "_first").alias("component_id")))
    out = marked.join(results, "embedding", "left").select(
        F.col("id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id)
