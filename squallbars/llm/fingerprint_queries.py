"""Query of the fingerprint operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallbars.llm.common import documents
from squallbars.llm.fingerprints import fingerprints
from squallbars.llm.registry import query


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprints(documents(spark, sf_dir)).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
