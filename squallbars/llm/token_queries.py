"""Queries of the operators that encode texts."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallbars.llm.common import documents
from squallbars.llm.packing import pack
from squallbars.llm.registry import query
from squallbars.llm.token_counts import token_counts
from squallbars.llm.token_files import token_digests, with_starts, write_tokens
from squallbars.session import shared_dir


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 1,024 tokens."""
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to files and what the files say of them."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    files = spark.read.parquet(folder)
    return with_starts(token_digests(files), files).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counts = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
