"""What the operators on conversations share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from squallbars.llm.common import written


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with `place`, a number that grows along (conv, turn, role, text); a hot conversation is dealt to many tasks."""
    dealt = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64))
    return written(dealt.sortWithinPartitions("conv", "turn", "role", "text").withColumn("place", F.monotonically_increasing_id()), "turns")


def line_digests(lines: DataFrame, conv: str, order: list[str], line: str, name: str) -> DataFrame:
    """(conv, name): SHA-256 of each conversation's lines in order, joined by newlines.

    Lines stream through a hash, so a task holds one batch of rows whatever the length of a conversation; the digest itself
    can only be taken line after line.
    """
    kind = lines.schema[conv].dataType
    schema = pa.schema([(conv, to_arrow_type(kind)), (name, pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is not None and key == current:
                    state.update(b"\n")
                else:
                    if state is not None:
                        out.append((current, state.hexdigest()))
                    current, state = key, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], schema[0].type), pa.array([state.hexdigest()])], schema=schema)

    dealt = lines.repartition(conv).sortWithinPartitions(conv, *order)
    return dealt.select(F.col(conv), F.col(line)).mapInArrow(digest, f"`{conv}` {kind.simpleString()}, {name} string")
