"""Personal data: patterns against plain regular expressions, the field against enumeration."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa

from squallbars.llm.crf import ChainField, features, shape, tokens
from squallbars.llm.private_data import LABELLED, added_spans, bounded, find_private, redact, trained
from squallbars.llm.private_patterns import KINDS, base_spans, luhn

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = {}
    for kind, pattern in PLAIN.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out[kind].append(m.span())
    return out


def test_patterns_equal_plain_ones():
    rng = random.Random(1)
    parts = ["a", "Z", "@", ".", "-", "+", "%", "_", "1", "23", "255", "256", "007", " ", "(", ")", "é", "٣", "\n", "4111111111111111", "+1 555 123 4567", "x@y.z", "10.0.0.1", "4111 1111-1111 1111"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base_spans(text) == plain_spans(text), text


def test_patterns_are_linear():
    for text in ("1" * 300_000, "a" * 300_000, "a." * 150_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000):
        base_spans(text)


def test_field_decodes_the_best_path():
    rows = ["call <phone>12 34</phone> now", "no 7 here", "a <card>9 9 9</card>", "<ip>1.2.3.4</ip> up"]
    field = ChainField.train(rows, KINDS, steps=40)
    rng = np.random.default_rng(1)
    small = ChainField(("k",), {"f0": 0, "f1": 1, "f2": 2}, np.vstack([rng.normal(size=(3, 3)), np.zeros(3)]), ChainField._allowed(3) + rng.normal(size=(4, 3)))
    sequences = [[(f"f{x}",) for x in rng.integers(0, 3, n)] for n in (1, 2, 5, 6, 3)]

    def value(seq, path):
        total, before = 0.0, 3
        for f, y in zip(seq, path, strict=True):
            total += small.moves[before, y] + small.weights[small.names[f[0]], y]
            before = y
        return total

    for seq, path in zip(sequences, small.decode(sequences), strict=True):
        best = max(itertools.product(range(3), repeat=len(seq)), key=lambda p: value(seq, p))
        assert tuple(path) == best
    assert len(field.decode([[], [("0x",)]])) == 2


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(2)
    weights, moves = np.vstack([rng.normal(size=(4, 3)), np.zeros(3)]), ChainField._allowed(3) + rng.normal(size=(4, 3)) * 0.5
    at, gold, mask = rng.integers(0, 4, (2, 4, 2)), np.array([[0, 1, 2, 0], [1, 2, 0, 0]]), np.array([[1, 1, 1, 1], [1, 1, 1, 0]], bool)

    def likelihood(w, m):
        total = 0.0
        for a, y, k in zip(at, gold, mask.sum(1), strict=True):
            score = w[a].sum(1)
            value = lambda p: m[3, p[0]] + sum(m[p[i - 1], p[i]] for i in range(1, k)) + sum(score[i, p[i]] for i in range(k))  # noqa: B023, E731
            total += value(y) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(3), repeat=int(k))))
        return total

    dw, dm = ChainField._gradient(weights, moves, at, gold, mask)
    for i, j in ((0, 0), (1, 2), (3, 1)):
        step = np.zeros_like(weights)
        step[i, j] = 1e-5
        assert abs((likelihood(weights + step, moves) - likelihood(weights - step, moves)) / 2e-5 - dw[i, j]) < 1e-4
    for i, j in ((0, 1), (1, 2), (3, 0), (3, 1)):
        step = np.zeros_like(moves)
        step[i, j] = 1e-5
        assert abs((likelihood(weights, moves + step) - likelihood(weights, moves - step)) / 2e-5 - dm[i, j]) < 1e-4


def test_field_adds_what_patterns_miss():
    field = trained()
    wanted = {"please call (312) 555-0142 today": "phone", "mail me: pat.doe (at) example (dot) com ok": "email", "reach us: sam [at] site [dot] org": "email"}
    for text, kind in wanted.items():
        assert [k for k, _, _ in added_spans([text], [base_spans(text)], field)[0]] == [kind], text
    clean = ["in 1999 there were 4500 of them", "order no 123456789 was sent on 2024-03-17", "version 3.14.2 and page 12 of 345", "he sat (at) the table", "no digits at all"]
    assert added_spans(clean, [base_spans(t) for t in clean], field) == [[] for _ in clean]
    assert len(LABELLED) < 200


def test_rows(edges, empty, spark):
    rows = find_private(edges).collect()
    assert len(rows) == edges.count() and not any(r.base for r in rows)
    assert find_private(empty).count() == 0
    docs = spark.createDataFrame([(1, "é a@b.co and 10.0.0.1, +49 30 1234567", "keep"), (2, None, "keep"), (3, "clean text", "keep")], "doc_id long, text string, base string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in find_private(docs).collect()}
    assert found == {1: [("email", 2, 8), ("ip", 13, 21), ("phone", 23, 37)], 2: [], 3: []}
    assert {r.doc_id: (r.text, r.base) for r in redact(docs).collect()} == {1: ("é <EMAIL> and <IP>, <PHONE>", "keep"), 2: (None, "keep"), 3: ("clean text", "keep")}


def test_field_reads_whole_texts():
    field = trained()
    wanted = {"contact bob [At] mail [Dot] org for the list": "email", "write to jane @ example . com today": "email", "the host at 192 . 168 . 0 . 17 is down": "ip"}
    for text, kind in wanted.items():
        assert [k for k, _, _ in added_spans([text], [base_spans(text)], field)[0]] == [kind], text


def test_texts_decode_like_their_features():
    field, rng = trained(), random.Random(4)
    words = ["at", "(", ")", "[Dot]", "@", ".", "12", "0049", "4111", "jane", "Tom", "ORG", "call", "-", "+", "!!", "\n", " ", "é", "٣", "<", "_"]
    texts = ["", " ", *LABELLED] + ["".join(rng.choice(words) + rng.choice(["", " ", " filler words in between "]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for text, runs in zip(texts, field.text_decoder().decode(texts), strict=True):
        spans = tokens(text)
        labels = {s: y for own, found in runs for s, y in zip(own, found.tolist(), strict=True)}
        assert [labels.get(s, 0) for s in spans] == field.decode([features(text, spans)])[0].tolist()


def test_character_tables_cut_and_shape_as_the_token_rules():
    """Letters of all cases, numbers that are no digits, white space of all kinds, and characters beyond the basic plane."""
    decoder = trained().text_decoder()
    rng = random.Random(4)
    signs = [*"aZ1 0.@_-\n\t\x1c\u00a0\u3000", "\u00b2", "\u01c5", "\u00aa", "\u2177", "\uff11", "\u0663", "\u212a", "\u0130", "\u00df", "at", "DOT", "Tel", "11", "invoice", "invoices", "<", ">"]
    texts = ["", " ", "\n", "x" * 50, "7" * 50, *("".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(3_000))]
    texts += [t + "\U0001f600 at 12" for t in texts[:50]] + [chr(c) + "a" + chr(c) for c in range(1, 0xd800)]
    for text in texts:
        first, end, codes = decoder._cut(text)
        spans = tokens(text)
        assert list(zip(first.tolist(), end.tolist())) == spans, repr(text)
        assert codes.tolist() == [decoder.shapes.get(shape(text[a:b]), decoder.other) for a, b in spans], repr(text)


def test_batches_are_decoded_in_bounded_parts():
    """A long batch is never decoded whole, nulls and rows beyond the bound included, and keeps its rows in order."""
    texts = ["x" * 30, None, "", "y" * 250, "é" * 20, *["z" * 40] * 7, None]
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": texts})
    parts = list(bounded(iter([batch, batch.slice(0, 0)]), "text", 100))
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist()
    sizes = [[len((t or "").encode()) for t in p.column("text").to_pylist()] for p in parts]
    assert all(sum(s) <= 100 or len(s) == 1 for s in sizes) and len(parts) == 6
