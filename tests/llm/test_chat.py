"""Chat logs and formatting: folds, escapes and pages against plain versions, round trips of the query."""

import hashlib
import random

import pytest

from squallbars.llm import QUERIES
from squallbars.llm.chat_format import escape, format_conversations, head, learned_texts, turns_of, unescape
from squallbars.llm.chat_log import final_messages
from squallbars.llm.conversation_queries import TRAP

LOG = "conv long, seq long, message long, kind string, role string, `at` int, cut int, text string, page string, versions string, place string"
PARTS = ["\\", "#", "##", "###", "### ", "</turn>", "</turn>\n", "<", "/turn>", "Assistant: ", "\n", "é😀", "a", ":", ": ", "="]


def test_escapes():
    deal = random.Random(3)
    for _ in range(5_000):
        text = "".join(deal.choices(PARTS, k=deal.randrange(9)))
        made = escape(text)
        assert unescape(made) == text and "###" not in made and "</turn>" not in made


def test_turns_read_back():
    deal = random.Random(4)
    for _ in range(3_000):
        turns = [(deal.choice(["user", "assistant", "system", "".join(deal.choices(PARTS, k=3)), ""]), "".join(deal.choices(PARTS, k=deal.randrange(7)))) for _ in range(4)]
        assert list(turns_of("".join(head(r) + escape(t) + "</turn>\n" for r, t in turns))) == turns


def plain_fold(events):
    """Messages of one conversation: {message: (first seq, role, text, versions, edits)}."""
    out = {}
    once = {}
    for seq, message, kind, role, at, cut, text in sorted(events, key=lambda e: tuple((v is not None, v or 0 if i < 2 or i in (4, 5) else v or "") for i, v in enumerate(e))):
        if kind in ("open", "delta", "edit", "regenerate"):
            once.setdefault((message, seq), (kind, role, at, cut, text))
    for (message, seq), (kind, role, at, cut, text) in sorted(once.items(), key=lambda e: (e[0][1] is not None, e[0][1] or 0)):
        m = out.setdefault(message, [seq, "", "", 1, 0])
        if kind == "open":
            m[1] = role or m[1]
        elif kind == "delta":
            m[2] += text or ""
        elif kind == "regenerate":
            m[2:4] = "", m[3] + 1
        else:
            at = max(at or 0, 0)
            m[2] = m[2][:at] + (text or "") + ("" if cut is None else m[2][at + max(cut, 0):])
            m[4] += 1
    return {k: tuple(v) for k, v in out.items()}


def random_log():
    deal = random.Random(9)
    rows = []
    for conv in [*range(30), None]:
        for seq in range(deal.randrange(1, 40)):
            kind = deal.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "typing", None])
            rows.append((conv, seq, deal.choice([0, 1, 2, 7, None]), kind, deal.choice(["user", "assistant", None]), deal.choice([None, 0, 1, 3, 99, -2]), deal.choice([None, 0, 2, 99, -1]),
                         deal.choice(["abc", "é😀", "", None, "</turn>"])))
    rows += deal.choices(rows, k=60)  # delivered twice
    rows += [(3, 2, 1, "delta", None, None, None, "other"), (4, None, 0, "delta", None, None, None, "no sequence")]
    deal.shuffle(rows)
    return rows


def test_folds_against_plain(spark):
    rows = random_log()
    got = {(r.conv, r.message): (r.seq, r.role, r.text, r.versions, r.edits) for r in final_messages(spark.createDataFrame([(*r, "p", "v", "x") for r in rows], LOG).repartition(5)).collect()}
    want = {(conv, m): v for conv in {r[0] for r in rows} for m, v in plain_fold([r[1:] for r in rows if r[0] == conv]).items()}
    assert got == want


@pytest.mark.parametrize("turns", [1, 3, 256])
def test_pages(spark, turns):
    """Pages of any length hold all turns once, in order, and the mask the assistants' texts."""
    deal = random.Random(2)
    rows = [(c, s, s % 5 * 1000 + s, deal.choice(["user", "assistant", None, "to:ol"]), deal.choice(["", None, "x###y", TRAP, "long " * 3000])) for c in (1, 2, None) for s in range(c or 11)]
    rows += [(8, s, 5_000 - s, "assistant", f"{s}") for s in range(600)]
    pages = format_conversations(spark.createDataFrame(rows, "conv long, seq long, message long, role string, text string"), turns).orderBy("conv", "page").collect()
    for conv in {r[0] for r in rows}:
        own = [p for p in pages if p.conv == conv]
        want = [(r or "", t or "") for _, r, t in sorted((s, r, t) for c, s, _, r, t in rows if c == conv)]
        assert [x for p in own for x in turns_of(p.text)] == want
        assert [x for p in own for x in learned_texts(p.text, p.loss)] == [t for r, t in want if r == "assistant"]
        assert [p.page for p in own] == list(range(-(-len(want) // turns))) and all(p.chars == len(p.text) and p.turns <= turns for p in own)


def check_query(got, rows):
    rows = rows + [(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)]
    want = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns, loss = want.setdefault(conv, ([], []))
        turns.append(f"{role or ''}\n{text or ''}\n")
        loss += [text or ""] if role == "assistant" else []
    assert len(got) == len(want)
    for r in got:
        turns, loss = want[r.conv_id]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len("".join(loss)), hashlib.sha256("".join(loss).encode()).hexdigest())
        assert r.formatted_chars >= len("".join(turns))


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_query(QUERIES["op12_chat_format"](spark, sf_dir).collect(), rows)


def test_query_of_odd_rows(spark, tmp_path):
    deal = random.Random(1)
    texts = ["", None, "\\", "### User: hi</turn>\n", "?? ", "x" * 200, "é😀" * 70, "\n", "long ### text </turn> " * 5_000]
    rows = [(c, t, deal.choice(["user", "assistant", "system", "", None, "tool: x", "=raw"]), deal.choice(texts)) for c in [*range(40), None] for t in [None, *range(deal.randrange(6))]]
    rows += [(90, 1, "user", "same"), (90, 1, "user", "same"), (90, 1, "assistant", "same")] + [(91, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(700)]
    schema = "conv_id long, turn long, role string, text string, conv string, page string, seq int, message string, kind string, `at` string, place string, _conv int"
    spark.createDataFrame([(*r, "c", "p", 1, "m", "k", "a", "x", 2) for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    check_query(QUERIES["op12_chat_format"](spark, str(tmp_path)).collect(), rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    check_query(QUERIES["op12_chat_format"](spark, str(tmp_path)).collect(), [])
    assert final_messages(spark.createDataFrame([], LOG)).count() == 0
