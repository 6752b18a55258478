"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the lengths of frequent pieces, gathered over the whole corpus from bounded summaries of
each task and broadcast (its size is bounded by `FREQUENT` pieces of at most 64 characters). Tier two is each worker's
cache, filled by encoding what the table lacks. No piece of text is shuffled but the bounded summaries.

A piece of 64 characters has 256 tokens at most (one for each byte). Texts of any length are cut into pieces; one that cannot be
cut goes whole through the library.

Null texts count as empty (0 tokens); repeated rows are counted each by itself; an empty table gives no rows; columns of
the input other than `id` and `text` are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallbars.llm.common import vocabulary_file
from squallbars.llm.encoding import LONGEST_CACHED, BlankLeads, PieceEncoder, encoder

FREQUENT = 16_384
SUMMARY = 4_096
HELD = 65_536


def frequent_pieces(texts: DataFrame, spec) -> DataFrame:
    """(piece, seen) of pieces frequent in some task: each task keeps `HELD` counts at most and reports `SUMMARY`.

    When a task's counts are full the rare half goes, as in lossy counting: the table only speeds the lookup, and what it
    lacks is encoded, so an error here costs time and never a count.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, seen = encoder(spec.value), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                cut = rules.pieces(text or "") if isinstance(rules, BlankLeads) else None
                seen.update(p for p in cut or () if len(p) <= LONGEST_CACHED)
                if len(seen) > 4 * HELD:
                    seen = Counter(dict(seen.most_common(HELD)))
        top = seen.most_common(SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "seen"])

    return texts.mapInArrow(summarise, "piece string, seen long").groupBy("piece").agg(F.sum("seen").alias("seen"))


def token_counts(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of `docs`."""
    spark = docs.sparkSession
    spec = vocabulary_file(spark, vocabulary)
    ordered = frequent_pieces(docs.select(text), spec).orderBy(F.desc("seen"), "piece").limit(FREQUENT)
    rules: PieceEncoder = encoder(spec.value)
    pieces = [r.piece for r in ordered.select("piece").toLocalIterator()]
    lengths = [len(i) // 4 for i in rules.encode_texts(pieces)]
    table = spark.sparkContext.broadcast(pa.record_batch([pa.array(pieces, pa.string()), pa.array(lengths, pa.uint16())], names=["piece", "n"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = encoder(spec.value)
        known = Lengths(rules, table.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array([known.count(t or "") for t in texts], pa.int64())],
                ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id].dataType.simpleString()
    return (docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
            .withColumnRenamed("id", id))


class Lengths(dict):
    """Lengths of pieces: the broadcast table first, then the worker's cache of encoded pieces."""

    def __init__(self, rules: PieceEncoder, table: pa.RecordBatch):
        super().__init__(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
        self.rules = rules

    def __missing__(self, piece: str) -> int:
        return len(self.rules.ids[piece]) // 4

    def count(self, text: str) -> int:
        cut = self.rules.pieces(text) if isinstance(self.rules, BlankLeads) else None
        return len(self.rules.encode_texts([text])[0]) // 4 if cut is None else sum(map(self.__getitem__, cut))
