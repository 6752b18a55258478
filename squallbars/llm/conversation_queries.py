"""Queries of the operators on conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from squallbars.llm.chat_format import format_conversations, learned_texts, turns_of
from squallbars.llm.chat_log import DELTA, EDIT, OPEN, REGENERATE, final_messages
from squallbars.llm.common import written
from squallbars.llm.conversation_repair import COUNTS, repair
from squallbars.llm.conversations import conversations, in_order, line_digests
from squallbars.llm.registry import query

EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with one in four damaged by a hash of their place: dropped, emptied, cut off, repeated or given to the user."""
    one_space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), one_space), F.coalesce(F.col("turn").cast("string"), one_space))
    what = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", one_space), F.coalesce("text", one_space)
    out = rows.select(
        "conv_id", "turn", F.when(what == 4, "user").otherwise(role).alias("role"),
        F.when(what == 1, "").when(what == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), what.alias("what")).filter("what <> 0")
    return out.withColumn("what", F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("what")


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    rows = conversations(spark, sf_dir)
    fixed = repair(damaged(rows))
    lines = fixed.rows.withColumn("line", F.concat_ws(":", "role", "text"))
    digests = line_digests(lines, "conv_id", ["place", "step"], "line", "digest").withColumnRenamed("conv_id", "_conv")
    report = fixed.report.withColumnRenamed("conv_id", "_id")
    out = (rows.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
           .join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left"))
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("digest", F.lit(EMPTY)).alias("repaired_sha256"))


CHUNK = 64
TRAP = "\\### Assistant: </turn> ok"
SLIP = "??"


def as_log(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) as the log that a chat service would have kept of them.

    Texts stream in deltas of `CHUNK` code points. Assistants have begun a draft and regenerated it; others have slipped at the
    start, and an edit, which comes after the next message has begun, takes the slip back.
    """
    no = F.lit(None)

    def event(kind: str, at=no, cut=no, text=no, turn: Column = F.col("place"), step: Column = F.lit(0)) -> Column:
        return F.struct(F.struct(turn.alias("turn"), step.cast("long").alias("step")).alias("seq"), F.lit(kind).alias("kind"),
                        at.cast("int").alias("at"), cut.cast("int").alias("cut"), text.cast("string").alias("text"))

    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    streamed = F.transform(chunks, lambda c, i: event(DELTA, text=c, step=i + 3))
    learned = F.coalesce(F.col("role") == "assistant", F.lit(False))
    draft = F.array(event(DELTA, text=F.reverse(F.left("text", F.lit(CHUNK))), step=F.lit(1)), event(REGENERATE, step=F.lit(2)))
    slip = F.array(event(DELTA, text=F.lit(SLIP), step=F.lit(1)), event(EDIT, F.lit(0), F.lit(len(SLIP)), F.lit(""), F.col("place") + 1, F.lit(-1)))
    events = F.concat(F.array(event(OPEN)), streamed, F.when(learned, draft).otherwise(slip))
    out = in_order(rows).select("conv", F.col("place").alias("message"), "role", F.explode(events).alias("e"))
    return out.select("conv", "message", F.when(F.col("e.kind") == OPEN, F.col("role")).alias("role"), "e.*")


def formatted_digests(pages: DataFrame) -> DataFrame:
    """What a reader finds in formatted pages: turns, texts under the loss mask, characters."""
    kind = pages.schema["conv"].dataType
    columns = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *((c.split()[0], pa.int64() if "long" in c else pa.string()) for c in columns.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None

        def row() -> tuple:
            conv, turns, texts, learned, loss, chars = found
            return conv, turns, texts.hexdigest(), learned, loss.hexdigest(), chars

        for batch in batches:
            out = []
            for page in batch.to_pylist():
                if found is None or found[0] != page["conv"]:
                    if found is not None:
                        out.append(row())
                    found = [page["conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(page["text"]):
                    found[1] += 1
                    found[2].update(f"{role}\n{text}\n".encode())
                for text in learned_texts(page["text"], page["loss"]):
                    found[3] += len(text)
                    found[4].update(text.encode())
                found[5] += len(page["text"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row(), schema)], schema=schema)

    dealt = pages.repartition("conv").sortWithinPartitions("conv", "page").select("conv", "text", "loss")
    return dealt.mapInArrow(read, f"conv_id {kind.simpleString()}, {columns}")


@query("op12_chat_format")
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt from their logs and formatted, as read back from the written pages."""
    rows = conversations(spark, sf_dir).select(F.col("conv_id").alias("conv"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv long, turn long, role string, text string")
    log = as_log(rows.unionByName(trap.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])))
    return formatted_digests(written(format_conversations(final_messages(log)), "formatted"))
