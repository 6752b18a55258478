"""Personal data: exact patterns, and spans that a linear-chain conditional random field adds to them.

The field is trained on the driver from the small table below and sent to the executors (some thousand numbers). It decodes
every token of every text. A span that it finds is added where it touches no pattern span and has what its kind needs.

Null texts are empty and have no spans; repeated rows are treated alike; an empty table gives no rows; columns other than
`id` and `text` are ignored by `find_private` and kept by `redact`. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallbars.llm.common import release
from squallbars.llm.crf import ChainField, TextDecoder
from squallbars.llm.private_patterns import KINDS, base_spans, is_ip

TOGETHER = 2_000_000  # bytes of text decoded at once
LONGEST_EMAIL = 254  # RFC 5321; a longer run of the field's is no address

# The labelled table (fixed values): one text a row, spans between tags.
LABELLED = [
    "write to <email>jane.doe (at) example (dot) com</email> today",
    "contact <email>bob [at] mail [dot] org</email> for the list",
    "reach me: <email>k.lee(at)site(dot)net</email>.",
    "my address is <email>anna_smith [at] post.example.com</email>, thanks",
    "send it to <email>info (AT) example (DOT) org</email> or not",
    "or mail <email>tom7 {at} host {dot} com</email> with the file",
    "ask <email>jane.doe@example.com</email> about it",
    "from <email>a.b-c@mail.example.org</email> to all",
    "call <phone>(578) 555-6437</phone> after noon",
    "phone <phone>555-867-5309</phone> or come by",
    "tel <phone>0049 30 1234567</phone> in the office",
    "mobile: <phone>0176 5550 1234</phone>, ask for Tom",
    "call me at <phone>212.555.0187</phone> please",
    "fax <phone>(030) 555 0199</phone> and wait",
    "phone <phone>+1 (578) 555-6437</phone> now",
    "reach her on <phone>+44 20 7946 0958</phone> today",
    "the number is <phone>(212) 555-0123</phone>. Do not tell",
    "tel: <phone>(415) 555-2671</phone>",
    "paid by card <card>4111 1111 1111 1111</card> yesterday",
    "visa <card>4918187128635271</card> was used",
    "card no <card>5500-0000-0000-0004</card> expires soon",
    "the host at <ip>192.168.0.17</ip> is down",
    "ip <ip>10.0.0.254</ip> answered",
    "login from <ip>172.16.31.9</ip> failed twice",
    "order no 123456789 was sent on 2024-03-17 at 10:45",
    "version 3.14.2 of 12.06.2023 has 1,234,567 rows",
    "on page 12 of 345, see figure 7 (left)",
    "invoice 2023-000123 over 1.250,00 was paid",
    "isbn 978-3-16-148410-0 is out of print",
    "he was (at) home and (dot) it was",
    "in 1999 (see 12) there were 300 of 4500",
    "the id is 8391028374655512 and not a card",
    "from 10:30 to 12:45 on 01/02/2003",
    "chapter 3 section 4 paragraph 12",
    "temperature 21.5 to 23.75 in room 101",
    "score 3-2 after 90 minutes, 45 - 45",
    "sha 9f86d081884c7d65 and 2c26b46b68ffc68f",
    "build 20240317.1 took 12.5 s on 8 cores",
    "between 1914-1918 and 1939-1945",
    "add 2 + 2 = 4 and 10 - 3 = 7",
    "row 17 of 42 and column (3) of 5",
    "at 5 dot 7 they met",
    "key AKIA1234 5678 and token 12ab34cd",
    "the dot at the end and (at) last",
    "size 1024 x 768 pixels, 32 bit",
    "code 200 or 404 or 500 from port 8080",
    "license 2.0, copyright 2001-2015",
    "100 200 300 400 500 600 700",
    "ask for it at <email>jane @ example . com</email> please",
    "questions to <email>m.roe @ mail . site . org</email>, not by phone",
    "the server <ip>10 . 0 . 0 . 254</ip> is up",
    "we blocked <ip>172[.]16[.]20[.]30</ip> today",
    "so words!! AND MORE!! then WORDS,!! ONE.!! Two!! or none!!",
    "some words&&& and$$$ more,%%% or*** less.### Then&&& this*** was%%% the$$$ end###",
    "Long!! lines@@@ of~~~ junk^^^ are=== not, in--- any___ way||| an+++ address;;; or::: number",
]


def trained(rows: list[str] = LABELLED) -> ChainField:
    return ChainField.train(rows, KINDS)


def _fit(kind: str, part: str) -> bool:
    """Whether a span that the field found has what its kind needs."""
    digits = sum(c in "0123456789" for c in part)
    if kind == "email":
        return len(part) <= LONGEST_EMAIL and bool(re.search(r"\w\W*(?:@|[\[({] ?at ?[\])}])\W*\w.*(?:\.|dot)\W*\w", part, re.I | re.S))
    if kind == "phone":
        return 9 <= digits <= 15 and bool(re.search(r"[0-9][^0-9]+[0-9]", part))
    if kind == "ip":
        parts = re.fullmatch(r"\W*([0-9]+)" + r"\W*(?:\.|dot)\W*([0-9]+)" * 3 + r"\W*", part, re.I)
        return bool(parts) and is_ip(".".join(parts.groups()))
    return 13 <= digits <= 19


def added_spans(texts: list[str], base: list[dict[str, list[tuple[int, int]]]], field: ChainField,
                decoder: TextDecoder | None = None) -> list[list[tuple[str, int, int]]]:
    """Spans the field finds beside the pattern spans of each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, runs in enumerate((decoder or field.text_decoder()).decode(texts)):
        found: list[list] = []
        for spans, labels in runs:
            for (a, b), y in zip(spans, labels.tolist(), strict=True):
                if y and y % 2:
                    found.append([KINDS[(y - 1) // 2], a, b])
                elif y:
                    found[-1][2] = b
        taken = [s for k in KINDS for s in base[i][k]] if found else []
        for kind, a, b in found:
            if _fit(kind, texts[i][a:b]) and all(b <= s or e <= a for s, e in taken) and (kind, a, b) not in out[i]:
                out[i].append((kind, a, b))
    return out


def bounded(batches: Iterator[pa.RecordBatch], text: str, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (one row at least): decoding holds some twenty times its texts."""
    for batch in batches:
        sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_numpy(zero_copy_only=False), float)))
        at = 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def find_private(docs: DataFrame, id: str = "doc_id", text: str = "text", field: ChainField | None = None) -> DataFrame:
    """(id, base, added) of every row: spans as arrays of (kind, start, end), by kind and then by start."""
    model = docs.sparkSession.sparkContext.broadcast(field or trained())
    span = "array<struct<kind:string,start:int,end:int>>"
    kind = docs.schema[id].dataType.simpleString()
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = model.value.text_decoder()
        for batch in bounded(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, model.value, decoder)
            listed = [[{"kind": k, "start": a, "end": b} for k in KINDS for a, b in found[k]] for found in base]
            more = [[{"kind": k, "start": a, "end": b} for k, a, b in sorted(s, key=lambda x: (KINDS.index(x[0]), x[1]))] for s in added]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(listed, arrow), pa.array(more, arrow)], ["id", "base", "added"])

    return (docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(find, f"id {kind}, base {span}, added {span}")
            .withColumnRenamed("id", id))


def redact(docs: DataFrame, text: str = "text", field: ChainField | None = None) -> DataFrame:
    """The rows with every span of `text` replaced by its kind in angle brackets; all other columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(field or trained())

    def cleaned(value: str, base: dict, added: list) -> str:
        spans = sorted([(a, b, k) for k in KINDS for a, b in base[k]] + [(a, b, k) for k, a, b in added])
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [value[at:a], f"<{k.upper()}>"]
            at = max(at, b)
        return "".join([*out, value[at:]])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        decoder = model.value.text_decoder()
        for batch in bounded(batches, text):
            at = batch.schema.get_field_index(text)
            values = batch.column(at).to_pylist()
            texts = [t or "" for t in values]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, model.value, decoder)
            new = [v if v is None else cleaned(v, b, a) if any(b.values()) or a else v for v, b, a in zip(values, base, added, strict=True)]
            yield batch.set_column(at, text, pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
