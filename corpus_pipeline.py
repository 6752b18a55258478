"""The corpus pipeline: documents in, packed sequences out.

Each stage works on all rows that the one before kept, as Parquet. Stages keep the columns of `documents`; the last returns
the place of every piece of every document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallbars.llm.common import documents, written
from squallbars.llm.language_id import predict
from squallbars.llm.language_queries import document_model
from squallbars.llm.mixing import mix, word_count
from squallbars.llm.ngram_join import keep_one
from squallbars.llm.packing import pack
from squallbars.llm.private_data import redact

LEAST_SCORE = 0.5


def unused(docs: DataFrame, name: str) -> str:
    """`name`, lengthened until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows, with a posterior of `LEAST_SCORE` at least.

    Null, empty and letterless texts have none and go; repeated rows are judged alike; an empty table stays empty.
    """
    names = unused(docs, "language"), unused(docs, "posterior")
    named = predict(docs, document_model(docs), names=names)
    return named.filter((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_SCORE)).drop(*names)


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of similar documents, that with the least id; texts without words are like no other."""
    return keep_one(docs)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each span of personal data; `n_chars` counts the new text. Null texts stay null."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it.

    Rows match their rate by id, source and size (nulls as values); equal rows have the same. Documents without words go.
    """
    copies = mix(docs).filter("copies > 0").select("doc_id", "source", "size", "copies").distinct().alias("mix")
    same = (F.col("given.doc_id").eqNullSafe(F.col("mix.doc_id")) & F.col("given.source").eqNullSafe(F.col("mix.source"))
            & (word_count(F.col("given.text")) == F.col("mix.size")))
    row = F.struct(*[F.col(f"given.`{c}`") for c in docs.columns])
    taken = docs.alias("given").join(copies, same).select(F.explode(F.array_repeat(row, F.col("mix.copies").cast("int"))).alias("row"))
    return taken.select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and offset of every piece; null texts have the end id alone, copies are packed each by itself."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", similar_stage),
    ("PII", private_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

# Learned models, random-looking hashes and a genetic search have no SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, one after the other, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
