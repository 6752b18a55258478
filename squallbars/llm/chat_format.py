"""Messages rendered with a chat template that can be read back, and the mask of what a model learns from.

A turn is `### Role: text</turn>` and a line break. In texts and roles a backslash follows every backslash, every `#` before
two more and every `<` of `</turn>` (in roles also every colon before a blank), so that the template's marks occur nowhere else; a reader
drops one backslash before any character. Roles other than the three known ones are written after `=`.

Formatted conversations are written in pages of `PAGE_TURNS` turns at most, so that one conversation of any length fits no
task's memory at once; nearly all have one page. `loss` lists the spans (code points in the page) of the texts of assistants.

Nulls: a null text or role counts as empty; rows without a conversation id make one conversation. Repeated rows are turns like
others. Ties have the order of the sequence, then of the message. Empty texts give turns without text and an empty span. A very
long text is one turn, whole. Other columns are ignored. An empty table gives no pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from squallbars.llm.common import ranked, written

PAGE_TURNS = 256
HEADS = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {head: role for role, head in HEADS.items()}
CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
ROLE_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)|:(?= )")
TURN = re.compile(r"### (.*?): (.*?)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)
LEARNED = "assistant"


def head(role: str) -> str:
    return f"### {HEADS.get(role) or '=' + ROLE_CONTROL.sub(lambda m: m[0] + chr(92), role)}: "


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def turns_of(page: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted page."""
    for name, text in TURN.findall(page):
        yield unescape(name[1:]) if name.startswith("=") else ROLES[name], unescape(text)


def learned_texts(page: str, loss: list[dict]) -> Iterator[str]:
    """The texts under the loss mask."""
    return (unescape(page[s["start"]:s["start"] + s["length"]]) for s in loss)


class Page:
    def __init__(self, key: tuple):
        self.key, self.parts, self.length, self.loss, self.turns = key, [], 0, [], 0

    def add(self, role: str, text: str) -> None:
        front, body = head(role), escape(text)
        if role == LEARNED:
            self.loss.append({"start": self.length + len(front), "length": len(body)})
        self.parts += [front, body, "</turn>\n"]
        self.length += len(front) + len(body) + len("</turn>\n")
        self.turns += 1

    def row(self) -> dict:
        return dict(zip(("conv", "page", "text", "loss", "turns", "chars"), (*self.key, "".join(self.parts), self.loss, self.turns, self.length)))


def pager(conv: pa.DataType):
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    schema = pa.schema([("conv", conv), ("page", pa.int64()), ("text", pa.string()), ("loss", span), ("turns", pa.int64()), ("chars", pa.int64())])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Renders turns that come sorted by page."""
        current = None
        for batch in batches:
            ended = []
            for conv, page, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "page", "role", "text")), strict=True):
                if current is None or current.key != (conv, page):
                    if current is not None:
                        ended.append(current.row())
                    current = Page((conv, page))
                current.add(role, text)
            if ended:
                yield pa.RecordBatch.from_pylist(ended, schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.row()], schema)

    return pages


def numbered(messages: DataFrame) -> DataFrame:
    """Messages with `turn`, their place in the conversation from 0, without a window over any conversation."""
    places = ranked(messages.select("conv", "seq", "message"), F.col("conv"), F.col("seq"), F.col("message"), name="place")
    starts = places.groupBy(F.col("conv").alias("_conv")).agg(F.min("place").alias("_start"))
    turns = places.join(starts, F.col("conv").eqNullSafe(F.col("_conv"))).select(
        F.col("conv").alias("_conv"), F.col("message").alias("_message"), (F.col("place") - F.col("_start")).alias("turn"))
    same = F.col("message").eqNullSafe(F.col("_message")) & F.col("conv").eqNullSafe(F.col("_conv"))
    return messages.join(turns, same).drop("_conv", "_message")


def format_conversations(messages: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """(conv, page, text, loss, turns, chars) of messages (conv, seq, message, role, text); (conv, message) is a key."""
    messages = written(messages.select("conv", "seq", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "messages")
    turns = numbered(messages).withColumn("page", F.floor(F.col("turn") / page_turns))
    kind = messages.schema["conv"].dataType
    return (turns.repartition("conv", "page").sortWithinPartitions("conv", "page", "turn").select("conv", "page", "role", "text")
            .mapInArrow(pager(to_arrow_type(kind)), f"conv {kind.simpleString()}, page long, text string, loss array<struct<start: long, length: long>>, turns long, chars long"))
