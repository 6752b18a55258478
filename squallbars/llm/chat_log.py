"""Conversations rebuilt from their event logs.

A log row is (conv, seq, message, kind, role, at, cut, text). Partitioned by conversation and message and sorted by sequence,
the events of a message are folded into its last text:

* `open` begins a message and names its role (the last one named holds);
* `delta` appends text as it streams in;
* `edit` puts `text` in place of `cut` code points from `at` on (null `at`: from the start; null `cut`: all that follows;
  places past the end count as the end);
* `regenerate` drops the text so far: what streams next is a new version.

Messages stand in the order of their first event. A message's events depend on no other message, so the log is dealt by both
and a conversation of any length is spread over tasks; a task holds one message and one batch of events.

Nulls: a null text counts as empty, a message without a role as one with an empty role, null conversations, messages or
sequences as values of their own (first in order). An event delivered more than once (same conversation, message and sequence)
counts once; among different events of one sequence the first by kind, role, place and text counts. Other kinds are left out.
Very long texts are lists of deltas until an edit needs them whole. Other columns are ignored, whatever their names. An empty
log gives no messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
EVENT = ["conv", "seq", "message", "kind", "role", "at", "cut", "text"]
FOLDED = "role string, text string, versions long, edits long"


class Message:
    """One message while its events are folded."""

    def __init__(self, key: tuple):
        self.key, self.role, self.parts, self.versions, self.edits = key, "", [], 1, 0

    def apply(self, kind: str, role: str | None, at: int | None, cut: int | None, text: str | None) -> None:
        if kind == OPEN:
            self.role = role or self.role
        elif kind == REGENERATE:
            self.parts, self.versions = [], self.versions + 1
        elif kind == EDIT:
            whole, start = "".join(self.parts), max(at or 0, 0)
            rest = "" if cut is None else whole[start + max(cut, 0):]
            self.parts, self.edits = [whole[:start], text or "", rest], self.edits + 1
        elif text:
            self.parts.append(text)

    def row(self) -> tuple:
        return (*self.key, self.role, "".join(self.parts), self.versions, self.edits)


def folder(kinds: list[pa.DataType]):
    names = ["conv", "message", "seq", "role", "text", "versions", "edits"]
    schema = pa.schema(list(zip(names, [*kinds, pa.string(), pa.string(), pa.int64(), pa.int64()])))

    def rows(ended: list[Message]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*(m.row() for m in ended)), schema)], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Folds events that come sorted by conversation, message and sequence."""
        current, last = None, None
        for batch in batches:
            ended = []
            for conv, seq, message, *event in zip(*(batch.column(c).to_pylist() for c in EVENT), strict=True):
                if current is None or current.key[:2] != (conv, message):
                    if current is not None:
                        ended.append(current)
                    current, last = Message((conv, message, seq)), None
                if last != (seq,):
                    current.apply(*event)
                    last = (seq,)
            if ended:
                yield rows(ended)
        if current is not None:
            yield rows([current])

    return fold


def final_messages(log: DataFrame) -> DataFrame:
    """(conv, message, seq of its first event, role, text, versions, edits) of every message of a log."""
    known = log.select(*EVENT).filter(F.col("kind").isin(OPEN, DELTA, EDIT, REGENERATE))
    dealt = known.repartition("conv", "message").sortWithinPartitions("conv", "message", "seq", "kind", "role", "at", "cut", "text")
    kinds = [log.schema[c].dataType for c in ("conv", "message", "seq")]
    named = ", ".join(f"{c} {t.simpleString()}" for c, t in zip(("conv", "message", "seq"), kinds, strict=True))
    return dealt.mapInArrow(folder([to_arrow_type(t) for t in kinds]), f"{named}, {FOLDED}")
