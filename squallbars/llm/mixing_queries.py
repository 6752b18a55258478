"""Query of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from squallbars.llm.common import documents
from squallbars.llm.mixing import mix
from squallbars.llm.registry import query


@query("op7_source_mixing")
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
