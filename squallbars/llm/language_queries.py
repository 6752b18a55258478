"""Query of the language operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squallbars.llm.common import documents
from squallbars.llm.language_id import LanguageModel, predict, public_pieces, train
from squallbars.llm.registry import query


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def document_model(docs: DataFrame) -> LanguageModel:
    rows = docs.filter(~F.coalesce(held_out(), F.lit(False))).select("text", "lang")
    return train(rows, public_pieces(public_tokenizers.path("piece_bpe_32k.model")))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, document_model(docs)).drop("text")
