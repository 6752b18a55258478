"""Similarity join on the Jaccard of word shingles, with Bayesian pruning of candidates.

1. Each text becomes its set of distinct five-word shingles (64-bit digests). Texts of equal sets are one class.
2. MinHash values in `BANDS` bands of `ROWS`: classes that share a band are candidates. A pair of similarity 0.8 shares none
   with chance 1.3e-7. Inside a band's bucket, values are compared some at a time, and a pair is dropped as soon as the
   posterior probability that it reaches the threshold is below `tolerance`. Buckets give one edge for each class that still
   has a candidate, not their pairs, and connected candidates form a group.
3. Inside a group, all pairs are compared by further values in the same manner, and what remains is verified exactly on the
   whole sets. Large buckets and groups are dealt to pairs of blocks, so that no task holds one whole.

Returns a row for each document: its class (`class_id`, the least id among all documents it reaches by links), `n_links`
(documents linked directly, equal texts included) and `kept`. Texts that are null or without words link with nothing. Rows
with equal ids count as documents of their own; a null id is never the least of a class that has another. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallbars.llm.common import release, written
from squallbars.llm.components import components, deal_pairs
from squallbars.llm.near_vectors import linked_roots
from squallbars.llm.shingles import hash_seeds, least_matches, min_hashes, overlaps, shingles

BANDS, ROWS = 40, 5
FIRST = 64
STEP = 32
BLOCK_ROWS, BLOCK_WORDS = 1024, 500_000
TOLERANCE = 1e-7


def set_digest(found: np.ndarray) -> int:
    """A signed 64-bit digest of a set of shingles."""
    at = np.arange(1, len(found) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (found ^ at) * np.uint64(0xD6E8FEB86659FD93)
    return int(np.bitwise_xor.reduce(x ^ (x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).astype(np.int64))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys together, from batches sorted by the keys; a run over several batches is joined."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def survivors(left: np.ndarray, right: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Pairs of rows that no step of the comparison drops: values are compared `STEP` at a time."""
    alive = np.ones((len(left), len(right)), bool)
    equal = np.zeros(alive.shape, np.int32)
    for at in range(0, left.shape[1], STEP):
        n = min(at + STEP, left.shape[1])
        if alive.size <= 4096 or alive.mean() > 0.05:
            for k in range(at, n):
                equal += left[:, k, None] == right[None, :, k]
        else:
            i, j = np.nonzero(alive)
            equal[i, j] += (left[i, at:n] == right[j, at:n]).sum(1)
        alive &= equal >= needed[n]
        if not alive.any():
            break
    return alive


def _symmetric(table: pa.Table, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Link matrix of the rows of a pair of blocks; rows of one block are not compared where two blocks meet."""
    own, a, b = np.asarray(table.column("block")), table.column("a")[0].as_py(), table.column("b")[0].as_py()
    left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
    links = np.zeros((len(own), len(own)), bool)
    if len(left) and len(right):
        links[np.ix_(left, right)] = test(left, right)
    links |= links.T
    np.fill_diagonal(links, False)
    return links


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, node, n_shingles, bands, first): the digest of each text's set (null without words) and its MinHash values."""
    seeds = hash_seeds(BANDS * ROWS)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            node, size, bands, first = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, words)
                size.append(len(found))
                node.append(set_digest(found) if len(found) else None)
                values = min_hashes(found, seeds) if len(found) else None
                first.append(None if values is None else values[:FIRST].astype(np.uint8).tobytes())
                bands.append(None if values is None else _band_digests(values))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(first, pa.binary())],
                                             ["id", "node", "n_shingles", "bands", "first"])

    return docs.mapInArrow(sketch, f"id {docs.schema['id'].dataType.simpleString()}, node long, n_shingles long, bands array<long>, first binary")


def _band_digests(values: np.ndarray) -> np.ndarray:
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in values.reshape(BANDS, ROWS).T.astype(np.uint64):
        total = (total ^ column) * np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
    return total.astype(np.int64)


def candidate_groups(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, group) of classes that have a candidate: connected by pairs that share a band and survive the first values."""
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")).filter("n > 1").drop("n")
    members = banded.join(shared, "bucket").join(classes.select("node", "first"), "node")
    needed = least_matches(threshold, tolerance, FIRST)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for table in runs(batches, ["bucket", "a", "b"]):
            node = np.asarray(table.column("node"))
            values = np.frombuffer(b"".join(table.column("first").to_pylist()), np.uint8).reshape(len(node), FIRST)
            links = _symmetric(table, lambda i, j, v=values: survivors(v[i], v[j], needed))
            some = links.any(1)
            if some.any():
                src.append(node[some])
                dst.append(linked_roots(links, node)[some])
            if len(src) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])
                src, dst = [], []
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    dealt = deal_pairs(members, "bucket", "node", "blocks").select("bucket", "a", "b", "block", "node", "first")
    found = dealt.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").mapInArrow(edges, "src long, dst long")
    return components(found).select("node", F.col("component").alias("group"))


def linked_classes(docs: DataFrame, classes: DataFrame, groups: DataFrame, words: int, threshold: float, tolerance: float) -> DataFrame:
    """(node, links, root): for each linked class the documents of its linked classes, and the least class of its part of a group."""
    sized = groups.join(classes.select("node", "id", "copies", "n_shingles"), "node")
    blocks = sized.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_shingles") / BLOCK_WORDS)).alias("blocks"))
    wanted = sized.join(blocks, "group").select("group", "blocks", F.col("node").alias("_node"), F.col("id").alias("_id"), "copies")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(t, words) for t in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_digest(s) if len(s) else None for s in sets], pa.int64())], ["id", "text", "node"])

    texts = docs.mapInArrow(digests, f"id {docs.schema['id'].dataType.simpleString()}, text string, node long")
    one = (texts.join(wanted, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id")))
           .select("group", "blocks", "node", "copies", "text").dropDuplicates(["node"]))
    seeds, needed = hash_seeds(4 * STEP), least_matches(threshold, tolerance, 4 * STEP)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["group", "a", "b"]):
            node, copies = np.asarray(table.column("node")), np.asarray(table.column("copies"))
            sets = [shingles(t, words) for t in table.column("text").to_pylist()]
            values = np.stack([min_hashes(s, seeds) for s in sets])
            size = np.array([len(s) for s in sets])

            def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                alive = survivors(values[i], values[j], needed)
                rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
                out = np.zeros_like(alive)
                if len(rows):
                    both = overlaps(sets, i[rows], j[columns])
                    union = size[i[rows], None] + size[None, j[columns]] - both
                    out[np.ix_(rows, columns)] = both >= threshold * union - 1e-9
                return out & alive

            links = _symmetric(table, test)
            some = links.any(1)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array((links @ copies)[some]), pa.array(linked_roots(links, node)[some])], ["node", "links", "root"])

    dealt = deal_pairs(one, "group", "node", "blocks").select("group", "a", "b", "block", "node", "copies", "text")
    return dealt.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b").mapInArrow(verify, "node long, links long, root long")


def join_similar(docs: DataFrame, threshold: float = 0.8, words: int = 5, tolerance: float = TOLERANCE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_links, class_id, kept) of every row."""
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    members = written(shingle_sets(docs, words), "sketches")
    classes = written(members.filter(F.col("node").isNotNull()).groupBy("node")
                      .agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"),
                           F.first("bands").alias("bands"), F.first("first").alias("first")), "classes")
    groups = written(candidate_groups(classes, threshold, tolerance), "groups")
    found = written(linked_classes(docs, classes, groups, words, threshold, tolerance), "links")
    parts = written(components(found.select(F.col("node").alias("src"), F.col("root").alias("dst"))), "parts")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    tops = parts.join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("top"))
    named = parts.join(tops, "component").join(counts, "node", "left").select(F.col("node").alias("_node"), "top", "links")
    results = (classes.select("node", F.col("id").alias("_id"), "copies").join(named, F.col("node") == F.col("_node"), "left")
               .select("node", F.coalesce("top", "_id").alias("_class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links")))
    out = members.select("id", "node").join(results, "node", "left")
    return (out.select(F.col("id"), "node", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_class", "id").alias("class_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("class_id"))).withColumnRenamed("id", id))


def keep_one(docs: DataFrame, threshold: float = 0.8, words: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, one of each class of similar documents: that with the least id (of repeated rows, one)."""
    kept = join_similar(docs, threshold, words, id=id, text=text).filter("kept")
    ids = kept.select(F.col(id).alias("kept")).distinct().alias("stay")
    return docs.alias("given").join(ids, F.col(f"given.`{id}`").eqNullSafe(F.col("stay.kept")), "left_semi").dropDuplicates([id, text])
