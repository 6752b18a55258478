"""Token ids as Parquet list columns, in the order of document ids, with the starts of documents beside them.

`write_tokens` deals the documents by ranges of ids, so that each file holds a run of documents in order, encodes them
and writes rows (id, part, local_start, n_tokens, ids). Ids are dictionary encoded (one page of at most the vocabulary),
the other integers delta encoded; row groups and pages are small, and Parquet's page indexes let a reader of some
documents skip the other pages and a reader of metadata skip the ids altogether.

Null texts are empty (the end id alone); rows with equal ids are kept in the order of their texts; a null id comes first;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallbars.llm.common import running_base, vocabulary_file
from squallbars.llm.encoding import encoder, grouped

LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "512",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#id": "false",
    "parquet.enable.dictionary#part": "true",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every document to `folder`, files in ascending order of document ids."""
    spec = vocabulary_file(docs.sparkSession, vocabulary)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, start, part = encoder(spec.value), 0, TaskContext.get().partitionId()
        for batch in batches:
            keys, at = batch.column("id"), 0
            for some in grouped(batch.column("text").to_pylist()):
                ids, n = rules.encode_flat(some, end)
                ends = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(some)), pa.array(np.full(len(some), part), pa.int32()), pa.array(start + ends[:-1], pa.int64()), pa.array(n, pa.int64()), lists],
                    ["id", "part", "local_start", "n_tokens", "ids"])
                start, at = start + int(ends[-1]), at + len(some)

    kind = docs.schema[id].dataType.simpleString()
    (docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
     .repartitionByRange(F.col("id").asc_nulls_first())
     .sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
     .mapInArrow(encode, f"id {kind}, part int, local_start long, n_tokens long, ids array<int>")
     .write.options(**LAYOUT).parquet(folder))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(id, part, start, n_tokens, ids) of the files; only the columns and pages that a query asks for are read."""
    return with_starts(spark.read.parquet(folder), spark.read.parquet(folder))


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """`start`, which counts the ids of all documents before, in place of `local_start`; its bases are one row for each file."""
    bases = running_base(files.groupBy("part").agg(F.sum("n_tokens").alias("_n")), "part", "_n").select("part", "base")
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start")


def token_digests(rows: DataFrame) -> DataFrame:
    """`ids_crc32` of the ids as little-endian unsigned 32-bit integers, in place of `ids`."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = np.asarray(lists.flatten()).astype("<u4"), np.asarray(lists.offsets)
            ends = ends - ends[0]
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(crc, pa.int64())], [*kept, "ids_crc32"])

    kept = [c for c in rows.columns if c != "ids"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(digest, f"{schema}, ids_crc32 long")
