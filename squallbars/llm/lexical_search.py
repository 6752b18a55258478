"""Ranked lexical search over a length-stratified index: the best documents of every query.

A query's weight of a term is floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums weight times
(10^9 tf) div (1000 tf + 8 m) over the query's terms, once each. In a stratum the greatest counts of the terms bound the
scores (a document of n terms matches n of them at most). The `FIRST` strata of greatest bound are visited first and give a
query's threshold, its tenth score so far; then only slices whose own bound reaches the threshold are visited, and thresholds
rise within a task. A bound below the threshold proves that no document of the slice is among the best, so nothing is lost.

Queries are dealt to blocks of about `BLOCK_TERMS` terms; a block is what is broadcast (and gathered) at a time.

Nulls: a null query text has no terms and finds nothing; a null query id is a query like others. Rows with the same query id
are one query with the terms of all. Equal scores go by ascending document id, nulls last. Texts of any length are taken whole.
Other columns are ignored. An empty table of either kind gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from squallbars.llm.common import written
from squallbars.llm.lexical_index import Index, spaced, split_terms

FIRST = 16
BLOCK_TERMS = 1 << 16
CELLS = 1 << 22


class Queries:
    """A block of queries: its terms by number, and for each query the numbers and weights of its terms."""

    def __init__(self, rows: list):
        self.numbers = {t: i for i, t in enumerate(dict.fromkeys(r.term for r in rows))}
        self.ids = list(dict.fromkeys(r.item for r in rows))
        place = {item: i for i, item in enumerate(self.ids)}
        rows = sorted(rows, key=lambda r: place[r.item])
        self.query = np.array([place[r.item] for r in rows])
        self.term = np.array([self.numbers[r.term] for r in rows])
        self.weight = np.array([r.weight for r in rows], np.int64)
        self.starts = np.searchsorted(self.query, np.arange(len(self.ids)))
        self.sizes = np.diff(np.append(self.starts, len(rows)))

    def known(self, terms: pa.Array) -> np.ndarray:
        """Numbers of terms, -1 for others."""
        return np.array([self.numbers.get(t, -1) for t in terms.to_pylist()], np.int64)

    def bounds(self, terms: np.ndarray, most: np.ndarray, m: int, longest: int) -> np.ndarray:
        """For each query, what no document of normaliser `m` and at most `longest` terms scores above."""
        greatest = np.zeros(len(self.numbers), np.int64)
        np.maximum.at(greatest, terms, impact(most, m))
        parts = self.weight * greatest[self.term]
        out = np.add.reduceat(parts, self.starts)
        if longest < self.sizes.max():
            for q in np.flatnonzero(self.sizes > longest):
                own = parts[self.starts[q]:self.starts[q] + self.sizes[q]]
                out[q] = np.sort(own)[len(own) - longest:].sum()
        return out


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


def longest_of(m: int, docs: int, terms: int) -> int:
    """The most terms that a document of normaliser `m` has."""
    return ((m - 9) * terms - 1) // (90 * docs)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal `key`, which come together, as a table each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        ends = np.flatnonzero(np.concatenate((keys[1:] != keys[:-1], [True]))) + 1 if len(keys) else []
        start = 0
        for end in ends:
            if held and held[0].column(key)[0].as_py() != keys[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield pa.Table.from_batches(held)


class Slice:
    """Postings of a slice for the terms of a block of queries."""

    def __init__(self, rows: pa.Table, queries: Queries, docs: int, terms: int):
        self.queries, self.m = queries, rows.column("m")[0].as_py()
        head = pc.equal(rows.column("term"), "")
        self.ids = rows.filter(head).column("ids").combine_chunks().flatten()
        rest = rows.filter(pc.invert(head))
        number = queries.known(rest.column("term"))
        rest, number = rest.filter(pa.array(number >= 0)), number[number >= 0]
        order = np.argsort(number, kind="stable")
        rest, self.number = rest.take(pa.array(order)).combine_chunks(), number[order]
        self.tf = rest.column("tf").to_numpy()
        self.counts = rest.column("n").to_numpy()
        lists = rest.column("at").combine_chunks()
        self.at = (lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy() if len(rest) else np.zeros(0, np.int32)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self.impact = impact(self.tf, self.m)
        self.bounds = queries.bounds(self.number, self.tf, self.m, longest_of(self.m, docs, terms))

    def scores(self, chosen: np.ndarray) -> np.ndarray:
        """Scores of all documents of the slice for the queries `chosen` (ascending), a row each."""
        q = self.queries
        out = np.zeros((len(chosen), len(self.ids)), np.int64)
        wanted = np.isin(q.query, chosen)
        row = np.searchsorted(chosen, q.query[wanted])
        first, last = np.searchsorted(self.number, q.term[wanted]), np.searchsorted(self.number, q.term[wanted], "right")
        lists = spread(first, last - first)  # posting lists of each query's terms
        row, weight = np.repeat(row, last - first), np.repeat(q.weight[wanted], last - first)
        places = self.at[spread(self.starts[lists], self.counts[lists])]
        np.add.at(out.reshape(-1), np.repeat(row * len(self.ids), self.counts[lists]) + places, np.repeat(weight * self.impact[lists], self.counts[lists]))
        return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `size` numbers each, one after the other."""
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes)
    return shift + np.arange(len(shift))


def visitor(block, thresholds, chosen: Callable | None, size: tuple[int, int], id: pa.DataType, k: int):
    """Scores slices that come together: candidates (query number, document, score), `k` of a query and slice at most."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value
        least = np.maximum(thresholds.value, 1)
        for rows in runs(batches, "slice"):
            part = Slice(rows, queries, *size)
            reach = np.flatnonzero(part.bounds >= least)
            if chosen:
                reach = reach[np.isin(reach, chosen(part.m))]
            reach = reach[np.argsort(-part.bounds[reach], kind="stable")]
            step = max(1, CELLS // max(1, len(part.ids)))
            for i in range(0, len(reach), step):
                some = np.sort(reach[i:i + step])
                some = some[part.bounds[some] >= least[some]]
                scores = part.scores(some)
                row, place = np.nonzero(scores >= least[some][:, None])
                table = pa.table({"query": some[row], "doc": part.ids.take(pa.array(place)), "score": scores[row, place]})
                table = table.take(pc.sort_indices(table, [("query", "ascending"), ("score", "descending"), ("doc", "ascending")], null_placement="at_end"))
                query = table.column("query").to_numpy()
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                full = rank == k - 1
                least[query[full]] = np.maximum(least[query[full]], table.column("score").to_numpy()[full])
                yield from table.filter(pa.array(rank < k)).combine_chunks().to_batches()

    return visit


def strata_bounds(block, size: tuple[int, int]):
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query number, m, bound) of strata, whose terms with their greatest counts come together."""
        queries = block.value
        for rows in runs(batches, "m"):
            m, number = rows.column("m")[0].as_py(), queries.known(rows.column("term"))
            bounds = queries.bounds(number[number >= 0], rows.column("tf").to_numpy()[number >= 0], m, longest_of(m, *size))
            found = np.flatnonzero(bounds)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), m)), pa.array(bounds[found])], ["query", "m", "bound"])

    return bound


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct (item, term) of queries (item, text)."""
    kind = queries.schema["item"].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents, terms = split_terms(spaced(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(parents)), terms.cast(pa.string())], ["item", "term"])

    return queries.filter("text IS NOT NULL").mapInArrow(split, f"item {kind.simpleString()}, term string").distinct()


def best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(rows: DataFrame, queries: Queries, size: tuple[int, int], id, k: int) -> DataFrame:
    """The best `k` documents of each query of a block, from the index rows of its terms and the slices' lists of ids."""
    spark = rows.sparkSession
    block = spark.sparkContext.broadcast(queries)
    tops = rows.filter("term <> ''").groupBy("m", "term").agg(F.max("tf").alias("tf")).repartition("m").sortWithinPartitions("m")
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "m")
    first = (tops.mapInArrow(strata_bounds(block, size), "query long, m long, bound long")
             .withColumn("visit", F.row_number().over(by_bound)).filter(F.col("visit") <= FIRST).select("query", "m").collect())
    strata: dict[int, list[int]] = {}
    for r in first:
        strata.setdefault(r.m, []).append(r.query)

    def visited(rows: DataFrame, least: np.ndarray, chosen: Callable | None) -> DataFrame:
        dealt = rows.repartition("slice").sortWithinPartitions("slice")
        visit = visitor(block, spark.sparkContext.broadcast(least), chosen, size, to_arrow_type(id), k)
        return best(dealt.mapInArrow(visit, f"query long, doc {id.simpleString()}, score long"), k)

    least = np.zeros(len(queries.ids), np.int64)
    some = rows.join(spark.createDataFrame([(m,) for m in strata], "m long"), "m", "left_semi").select(rows.columns)
    for r in visited(some, least, lambda m: strata[m]).filter(F.col("rank") == k).collect():
        least[r["query"]] = r["score"]
    return visited(rows, least, None)


def search(index: Index, queries: DataFrame, k: int = 10, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, doc, score): the best `k` documents of every query with a score above 0."""
    spark = queries.sparkSession
    kind = index.rows.schema["ids"].dataType.elementType
    items = query_terms(queries.select(F.col(id).alias("item"), F.col(text).alias("text")))
    item = items.schema["item"].dataType
    found = f"item {item.simpleString()}, rank int, doc {kind.simpleString()}, score long"
    # Written, so that the planner knows its size and, if that is small, sends it to the index instead of dealing the index.
    words = written(items.select("term").distinct().union(spark.createDataFrame([("",)], "term string")), "words")
    rows = written(index.rows.join(words, "term", "left_semi").select(index.rows.columns), "postings")
    df = rows.filter("term <> ''").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.docs + 2)) / (2 * F.col("df") + 1)))
    weighted = written(items.join(df, "term").select("item", "term", weight.cast("long").alias("weight")), "weights")
    blocks = -(-weighted.count() // BLOCK_TERMS)
    out = spark.createDataFrame([], found)
    for b in range(blocks):
        ours = weighted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        queries_of = Queries(ours.collect())
        if not queries_of.ids:
            continue
        terms = ours.select("term").distinct().union(spark.createDataFrame([("",)], "term string"))
        own = rows if blocks == 1 else rows.join(terms, "term", "left_semi").select(rows.columns)
        ids = spark.createDataFrame(list(enumerate(queries_of.ids)), f"query long, item {item.simpleString()}")
        out = out.union(search_block(own, queries_of, (index.docs, index.terms), kind, k).join(ids, "query").select("item", "rank", "doc", "score"))
    return out
