"""Helpers shared by the corpus operators: written intermediates, global order, broadcasts of vocabularies."""

from __future__ import annotations

import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squallbars.session import shared_dir


CACHES: list[dict] = []


def release(*kept: dict) -> None:
    """Empty this worker process's caches but those kept: operators that follow each other share the workers' memory."""
    for cache in CACHES:
        if not any(cache is k for k in kept):
            cache.clear()
    pa.default_memory_pool().release_unused()


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame as Parquet in the folder all executors share and read it again.

    Cuts the lineage: a lost executor costs the reading of a file, not the work before it.
    """
    folder = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(schema).parquet(folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_file(spark: SparkSession, path: str):
    """A tokenizer file (fixed size, a few MB) sent to the executors, which need not have it on their disks."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def running_base(counts: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """For one row per (by, part): the sum of `value` over earlier parts, as column `base`.

    `counts` has a row for each partition of a dealt table, so the window is over partitions, never over rows.
    """
    frame = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if by:
        frame = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum(value).over(frame), F.lit(0).cast("long")))


def ranked(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Dense 0-based position of every row in a global order, without gathering the rows in one task.

    Rows are dealt by range and sorted where they are; monotonically increasing ids give the place inside each range,
    and the sizes of the ranges (a row each) give the rest.
    """
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_id", F.monotonically_increasing_id()), "ranked")
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    bases = running_base(dealt.groupBy("_part").agg(F.count("*").alias("_n")), "_part", "_n")
    return (dealt.join(bases.select("_part", "base"), "_part")
            .withColumn(name, F.col("base") + F.col("_at")).drop("_id", "_part", "_at", "base"))
