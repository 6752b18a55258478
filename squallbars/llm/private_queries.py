"""Query of the personal-data operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squallbars.llm.common import documents
from squallbars.llm.private_data import find_private
from squallbars.llm.private_patterns import KINDS
from squallbars.llm.registry import query


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _in_order(spans: Column) -> Column:
    """Spans by kind as listed, then by start."""
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


@query("op9_private_data")
def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of personal data by kind, a digest of the pattern spans and all spans."""
    found = find_private(documents(spark, sf_dir)).withColumn("all", _in_order(F.concat("base", "added")))
    kinds = F.transform("all", lambda s: s["kind"])
    counts = [(F.size("all") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
