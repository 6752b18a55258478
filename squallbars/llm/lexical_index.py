"""A length-stratified index of documents for ranked lexical search.

Terms are runs of letters, digits and characters beyond ASCII; only A to Z are lower-cased. Documents with the same normaliser
`m = 10 + (90 * n * N) div L` (n terms in the document, N documents with terms, L terms in all) form a stratum: for them the
weight of a term depends on its count alone, so postings are lists by count, and a weight is computed once for each count.

Documents are dealt by stratum, strata of more than `DEALT_TERMS` terms in parts of about that size, so a stratum of any size is
spread over tasks, texts of any length weigh as much as they hold, and a task holds one batch; strata are cut into slices of at most `SLICE_TERMS` terms and `SLICE_DOCS` documents. An index row is (m, slice, term, tf, n,
at): `n` documents of the slice, at the places `at` of its list, hold `term` `tf` times. The list stands in the slice's row
with an empty term, as `ids`.

Nulls: a null text has no terms, and documents without terms are not in the index (they count neither in N nor in L). A null id
is an id like others. Rows with the same id are documents by themselves, and so are equal texts. Very long texts are a slice by
themselves. Other columns are ignored. An empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from squallbars.llm.common import written

SLICE_TERMS = 1 << 20
SLICE_DOCS = 4_096
DEALT_TERMS = 1 << 22
ROWS = 65_536
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Index(NamedTuple):
    """`rows` as in the module; `docs` and `terms` are N and L."""

    rows: DataFrame
    docs: int
    terms: int


def spaced(texts: pa.StringArray) -> pa.StringArray:
    """Texts with terms lower-cased and one blank in place of every other character: one pass over the bytes of a batch."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(LOWER)), offset=texts.offset)


def split_terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For texts out of `spaced`: the text that each term stands in, and the terms."""
    lists = pc.ascii_split_whitespace(texts)
    parents, terms = pc.list_parent_indices(lists), lists.flatten()
    solid = pc.not_equal(terms, "")
    return parents.filter(solid).to_numpy(), terms.filter(solid)


def with_lengths(docs: DataFrame) -> DataFrame:
    """(id, n, text) of documents with terms; the texts are `spaced`."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = spaced(batch.column("text"))
            n = np.bincount(split_terms(texts)[0], minlength=len(texts))
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), texts.cast(pa.string())], ["id", "n", "text"])
            yield out.filter(pa.array(n > 0))

    return docs.filter("text IS NOT NULL").mapInArrow(measure, f"id {docs.schema['id'].dataType.simpleString()}, n long, text string")


def cuts(m: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of slices in rows sorted by m."""
    start, terms = 0, 0
    for i in range(len(m)):
        if i > start and (m[i] != m[start] or terms + n[i] > SLICE_TERMS or i - start >= SLICE_DOCS):
            yield start, i
            start, terms = i, 0
        terms += n[i]
    if start < len(m):
        yield start, len(m)


def slice_postings(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, tf, offsets, places): for each term and count of a slice, the places of the texts that hold it so often."""
    parents, terms = split_terms(texts)
    coded = terms.dictionary_encode()
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(texts) + parents, return_counts=True)
    term, place = pairs // len(texts), pairs % len(texts)
    order = np.lexsort((place, tf, term))
    term, tf, place = term[order], tf[order], place[order]
    starts = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]))))
    return coded.dictionary.take(pa.array(term[starts])), tf[starts], np.append(starts, len(tf)), place.astype(np.int32)


def indexer(id: pa.DataType):
    schema = pa.schema([("m", pa.int64()), ("slice", pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("n", pa.int64()),
                        ("at", pa.list_(pa.int32())), ("ids", pa.list_(id))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index rows of documents that come sorted by m."""
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            m = batch.column("m").to_numpy()
            for start, end in cuts(m, batch.column("n").to_numpy()):
                part = batch.slice(start, end - start)
                terms, tf, offsets, places = slice_postings(part.column("text"))
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("id"))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((int(m[start]), number, "", 0, 0, None), schema)] + [ids], schema=schema)
                for i in range(0, len(terms), ROWS):
                    bounds = offsets[i:i + ROWS + 1]
                    k = len(bounds) - 1
                    lists = pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(places[bounds[0]:bounds[-1]]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(k, m[start])), pa.array(np.full(k, number)), terms.slice(i, k).cast(pa.string()), pa.array(tf[i:i + k]), pa.array(np.diff(bounds)),
                        lists, pa.nulls(k, schema.field("ids").type)], schema=schema)
                number += 1

    return index


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents, written; N and L are the only values that come to the driver."""
    measured = written(with_lengths(docs.select(F.col(id).alias("id"), F.col(text).alias("text"))), "spaced")
    n_docs, n_terms = measured.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    kind = measured.schema["id"].dataType
    strata = measured.withColumn("m", F.lit(10).cast("long") + F.expr(f"(90L * n * {n_docs}L) div {max(n_terms, 1)}L"))
    sizes = written(strata.groupBy("m").agg(F.ceil(F.sum("n") / DEALT_TERMS).alias("parts")), "strata")
    part = F.pmod(F.xxhash64("id", "text"), F.col("parts"))
    dealt = strata.join(sizes, "m").repartition("m", part).sortWithinPartitions("m").select("m", "n", "id", "text")
    rows = dealt.mapInArrow(indexer(to_arrow_type(kind)), f"m long, slice long, term string, tf long, n long, at array<int>, ids array<{kind.simpleString()}>")
    return Index(written(rows, "index"), n_docs, n_terms)
