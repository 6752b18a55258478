"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

Every row of a conversation is kept, given another role or deleted, and empty turns are inserted, at the least cost and, among
equals, with the least audit string; the roles left read `(s?(ua)+)?`. The search is a bidirectional Dijkstra over the edit
lattice (`edit_lattice`), on segments of `SEGMENT` rows at most, so that a conversation of any length is spread over tasks: a
segment gives the cheapest path for each state before and after it, a fold over the segments chains them (four audits, cut
where they agree), and the edits go back to the rows by segment.

Nulls: a null role or text counts as one space (a blank turn); null turns come first; rows without a conversation id make one
conversation. Rows of the same turn go by role, then text. Empty texts are blank turns. Texts of any length stay in the JVM
and are only moved. Repeated rows count as duplicates from the second on. Other columns are ignored, whatever their names. An
empty table gives empty frames.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from squallbars.llm.common import written
from squallbars.llm.conversations import in_order, schema_of
from squallbars.llm.edit_lattice import BLANK, DUPLICATE, ENDS, SOUND, STATES, TRUNCATED, cheapest, codes

SEGMENT_BITS = 8
SPACES = " \t\n\x0b\f\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Repair(NamedTuple):
    """`rows`: conv, place, step (their order), edit (K, R or I), role, text of every turn left. `report`: a row for each conversation."""

    rows: DataFrame
    report: DataFrame


def with_faults(ordered: DataFrame) -> DataFrame:
    """(conv, place, turn, initial, fault) of every row. Texts are compared by their SHA-256 with the role."""
    solid = F.rtrim("text", F.lit(SPACES))
    first_letter = F.left("role", F.lit(1))
    light = ordered.select(
        "conv", "place", "turn", F.when(first_letter.isin("s", "u", "a"), first_letter).otherwise("o").alias("initial"),
        (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.unhex(F.sha2(F.concat(F.char_length("role"), F.lit(":"), "role", "text"), 256)).alias("same"))
    again = (light.filter("not blank").groupBy("conv", "same").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
             .select(F.col("conv").alias("_conv"), F.col("same").alias("_same"), "first"))
    joined = light.join(again, (F.col("same") == F.col("_same")) & F.col("conv").eqNullSafe(F.col("_conv")), "left")
    fault = (F.when(F.col("blank"), BLANK).when(F.col("place") > F.col("first"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND))
    return joined.select("conv", "place", "turn", "initial", fault.alias("fault"))


def segments(rows: DataFrame, bits: int) -> DataFrame:
    """One row for each run of at most 2^bits rows of a conversation, in the order of `segment`."""
    run = F.sort_array(F.collect_list(F.struct("place", "turn", "initial", "fault")))
    grouped = rows.groupBy("conv", F.shiftright("place", bits).alias("segment")).agg(run.alias("run"))
    turns = F.filter(F.col("run.turn"), lambda t: t.isNotNull())
    out = grouped.select(
        "conv", "segment", F.array_join("run.initial", "").alias("initials"), F.array_join("run.fault", "").alias("faults"),
        F.array_min("run.place").alias("first"), F.array_min(turns).alias("low"), F.array_max(turns).alias("high"),
        F.size(F.array_distinct(turns)).alias("turns"))
    ends = out.groupBy(F.col("conv").alias("_conv")).agg(F.min("segment").alias("_low"), F.max("segment").alias("_high"))
    joined = out.join(ends, F.col("conv").eqNullSafe(F.col("_conv")))
    return joined.withColumn("opens", F.col("segment") == F.col("_low")).withColumn("closes", F.col("segment") == F.col("_high")).drop("_conv", "_low", "_high")


def segment_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `paths`: the cheapest (before, after, cost, audit) of each segment for the states it can begin and end in."""
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        paths = []
        for initials, faults, opens, closes in zip(*(batch.column(c).to_pylist() for c in ("initials", "faults", "opens", "closes")), strict=True):
            found = []
            for before in ("",) if opens else STATES:
                for after in (ENDS,) if closes else [(state,) for state in STATES]:
                    if label := cheapest(initials, faults, before, after):
                        found.append({"before": before, "after": after[0], "cost": label[0], "audit": label[1]})
            paths.append(found)
        yield batch.append_column("paths", pa.array(paths, kind))


class Conversation:
    """The fold over one conversation's segments: counts, and the least label for each state reached.

    Audits share their beginning soon after paths part; what all have in common is moved to `begun`.
    """

    def __init__(self, conv):
        self.conv, self.labels, self.begun = conv, {"": (0, "")}, []
        self.rows, self.counts = [], dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.low = self.high = None
        self.turns, self.illegal, self.last = 0, 0, ""

    def add(self, row: dict) -> None:
        for fault in self.counts:
            self.counts[fault] += row["faults"].count(fault)
        pairs = self.last + row["initials"]
        self.illegal += sum(pairs[i:i + 2] not in ("su", "ua", "au") for i in range(len(pairs) - 1))
        self.last = row["initials"][-1]
        if row["low"] is not None:  # turns ascend, so only the border can repeat one
            self.turns += row["turns"] - (self.high == row["low"])
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        self.rows.append((row["segment"], row["first"], row["initials"]))
        reached: dict[str, tuple[int, str]] = {}
        for path in row["paths"]:
            if path["before"] in self.labels:
                cost, audit = self.labels[path["before"]]
                label = cost + path["cost"], audit + path["audit"]
                reached[path["after"]] = min(reached.get(path["after"], label), label)
        least, most = min(audits := [a for _, a in reached.values()]), max(audits)
        same = next((i for i, (x, y) in enumerate(zip(least, most)) if x != y), len(least))  # as for the least and greatest, so for all
        self.begun.append(least[:same])
        self.labels = {state: (cost, audit[same:]) for state, (cost, audit) in reached.items()}

    def ended(self) -> Iterator[dict]:
        """A row for each segment with the edits of its rows; the last has the report."""
        (cost, rest), = self.labels.values()
        audit = "".join(self.begun) + rest
        report = {"gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE],
                  "truncated": self.counts[TRUNCATED], "illegal": self.illegal, "cost": cost, "audit": audit}
        at, state = 0, ""
        for k, (segment, first, initials) in enumerate(self.rows):
            start, left, closes = at, len(initials), k + 1 == len(self.rows)
            while at < len(audit) and (left or closes):
                left -= audit[at] != "I"
                at += 1
            edits, state = codes(audit[start:at], initials, state)
            yield {"conv": self.conv, "segment": segment, "first": first, "edits": edits, "report": report if closes else None}


def folder(conv: pa.DataType):
    report = pa.struct([*((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])
    schema = pa.schema([("conv", conv), ("segment", pa.int64()), ("first", pa.int64()), ("edits", pa.list_(pa.string())), ("report", report)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains the segments of each conversation, which come in order."""
        current = None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if current is not None and current.conv != row["conv"]:
                    out += current.ended()
                    current = None
                current = current or Conversation(row["conv"])
                current.add(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist(list(current.ended()), schema)

    return fold


def edited(ordered: DataFrame, edits: DataFrame, bits: int) -> DataFrame:
    """The turns left after the edits, in the order of (place, step)."""
    known = edits.select(F.col("conv").alias("_conv"), F.col("segment").alias("_segment"), "first", "edits")
    joined = ordered.join(known, (F.shiftright("place", bits) == F.col("_segment")) & F.col("conv").eqNullSafe(F.col("_conv")))
    letters = F.regexp_extract_all(F.element_at("edits", (F.col("place") - F.col("first") + 1).cast("int")), F.lit("."), F.lit(0))
    out = joined.select("conv", "place", "role", "text", F.posexplode(letters).alias("step", "letter")).filter("letter <> 'D'")
    role = F.when(F.col("letter") == "K", F.col("role")).when(F.lower("letter") == "u", "user").otherwise("assistant")
    inserted = F.col("letter").isin("U", "A")
    edit = F.when(F.col("letter") == "K", "K").when(inserted, "I").otherwise("R")
    return out.select("conv", "place", "step", edit.alias("edit"), role.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_bits: int = SEGMENT_BITS) -> Repair:
    """Cheapest repair of every conversation; see the module for odd rows and for what is returned."""
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    ordered = in_order(named)
    runs = segments(with_faults(ordered), segment_bits).repartition("conv", "segment")
    paths = runs.mapInArrow(segment_paths, f"{schema_of(runs)}, paths array<struct<before string, after string, cost long, audit string>>")
    kind = named.schema["conv"].dataType
    counts = ", ".join(f"{c}: long" for c in COUNTS)
    chained = paths.repartition("conv").sortWithinPartitions("conv", "segment").mapInArrow(
        folder(to_arrow_type(kind)), f"conv {kind.simpleString()}, segment long, first long, edits array<string>, report struct<{counts}, audit: string>")
    edits = written(chained, "edits")
    report = edits.filter("report is not null").select("conv", "report.*")
    return Repair(edited(ordered, edits, segment_bits).withColumnRenamed("conv", conv), report.withColumnRenamed("conv", conv))
