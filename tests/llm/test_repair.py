"""Repair of conversations: the search against all paths, the operator and its query against a plain version."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from squallbars.llm import QUERIES
from squallbars.llm.conversation_queries import damaged
from squallbars.llm.conversation_repair import repair
from squallbars.llm.edit_lattice import ENDS, search

LEGAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def plain_search(initials, faults):
    """All edit sequences by cost then audit, without a lattice: the first legal one."""
    heap, n = [(0, "", 0, "")], len(initials)
    seen = set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == n and LEGAL.fullmatch(roles):
            return cost, audit, roles
        tail = (at, roles[-1:], audit.endswith("I") and len(audit) - len(audit.rstrip("I")))
        if (cost, audit, tail) in seen:
            continue
        seen.add((cost, audit, tail))
        if not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        if not audit.endswith("III"):
            for role in "ua":
                heapq.heappush(heap, (cost + 5, audit + "I", at, roles + role))
        if at < n:
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles))
            if faults[at] not in "bd":
                extra = 5 * (faults[at] == "t")
                heapq.heappush(heap, (cost + extra, audit + "K", at + 1, roles + initials[at]))
                for role in "ua":
                    heapq.heappush(heap, (cost + 1 + extra, audit + "R", at + 1, roles + role))
    raise AssertionError


def dynamic(initials, faults):
    """(cost, audit) by a table over rows and states, forwards, for longer runs."""
    table = {"": (0, "")}
    def grown(table):
        for _ in range(3):
            for state, after in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                if state in table:
                    new = table[state][0] + 5, table[state][1] + "I"
                    table[after] = min(table.get(after, new), new)
        return table
    for initial, fault in zip(initials, faults, strict=True):
        out = {}
        for state, (cost, audit) in grown(table).items():
            moves = [(state, cost + 2, "D")]
            if fault not in "bd":
                extra = 5 * (fault == "t")
                moves += [(r, cost + 1 + extra, "R") for r in "ua"] + [(initial, cost + extra, "K")]
            for after, c, letter in moves:
                if letter == "D" or after in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    out[after] = min(out.get(after, (c, audit + letter)), (c, audit + letter))
        table = out
    return min(v for k, v in grown(table).items() if k in ENDS)


def test_search_against_all_edits():
    for n in (1, 2, 3):
        for initials in itertools.product("suao", repeat=n):
            for faults in itertools.product(".bt", repeat=n):
                cost, audit, _ = plain_search(initials, faults)
                assert search("".join(initials), "".join(faults), "", ENDS) == (cost, audit), (initials, faults)


def test_search_of_longer_runs():
    deal = random.Random(7)
    for _ in range(400):
        n = deal.randrange(1, 40)
        initials, faults = "".join(deal.choices("suao", (1, 4, 4, 1), k=n)), "".join(deal.choices(".bdt", (6, 1, 1, 1), k=n))
        assert search(initials, faults, "", ENDS) == dynamic(initials, faults)


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain_repair(rows):
    """What the operator says of one conversation's (conv, turn, role, text) rows."""
    rows = by_turn([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    faults, seen = "", set()
    for _, _, role, text in rows:
        solid = text.strip(SPACE)
        faults += "b" if not solid else "d" if (role, text) in seen else "." if solid[-1] in ".!?" else "t"
        seen.add((role, text))
    initials = "".join(r[2][:1] if r[2][:1] in ("s", "u", "a") else "o" for r in rows)
    turns = {r[1] for r in rows} - {None}
    cost, audit = dynamic(initials, faults)
    lines, at, state = [], 0, ""
    for letter in audit:
        turned = "assistant" if state == "u" else "user"
        if letter in "RI":
            state = turned[0]
        elif letter == "K":
            state = initials[at]
        if letter != "D":
            lines.append({"K": rows[at][2] if at < len(rows) else "", "R": turned, "I": turned}[letter] + ":" + ("" if letter == "I" else rows[at][3]))
        at += letter != "I"
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit), lines


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, conv string, place string, step int, edits string, report string, segment int, `first` int, same string"


def odd_rows():
    deal = random.Random(5)
    texts = ["Yes.", "No!", "Why", "", "  \n", None, "A long story, cut", "done? ", "é…", "ok." * 4000]
    rows = [(c, t, r, x) for c in range(-3, 60) for t in [*range(deal.randrange(1, 9)), *([None] if c % 7 == 0 else [])]
            for r, x in [(deal.choice(["user", "assistant", "system", "tool", None, "", "User"]), deal.choice(texts))]]
    rows += [(None, t, "user" if t % 2 else "assistant", f"null {t % 5}.") for t in (3, 9, 4)]
    rows += [(1000, t, ("user", "assistant")[t % 2] if t % 11 else "system", f"turn {t % 70}{'.' if t % 13 else ''}") for t in range(900)]
    rows += [(1001, None, "user", "same."), (1001, None, "user", "same."), (1002, 5, "assistant", "a."), (1002, 5, "user", "b.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", 1, "e", "r", 2, 3, "s") for r in rows], SCHEMA)


@pytest.mark.parametrize("bits", [0, 2, 8])
def test_repair_against_plain(spark, bits):
    """With segments of one row, a few rows and as in production."""
    rows = odd_rows()
    fixed = repair(frame(spark, rows).repartition(7), segment_bits=bits)
    want = {c: plain_repair(r) for c, r in grouped(rows).items()}
    report = {r.conv_id: tuple(r)[1:] for r in fixed.report.collect()}
    assert report == {c: w[0] for c, w in want.items()}
    lines = {}
    for r in fixed.rows.orderBy("place", "step").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {c: w[1] for c, w in want.items() if w[1]}


def check_query(got, rows):
    left = grouped(plain_damage(rows))
    want = set()
    for conv in grouped(rows):
        counts, lines = plain_repair(left[conv]) if conv in left else ((0,) * 6 + ("",), [])
        want.add((conv, *counts, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_query(QUERIES["op11_conversation_repair"](spark, sf_dir).collect(), rows)


def test_query_of_odd_rows(spark, tmp_path):
    frame(spark, odd_rows()).write.parquet(f"{tmp_path}/conversations.parquet")
    check_query(QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect(), odd_rows())


def test_damage(spark):
    rows = odd_rows()
    assert sorted(map(repr, damaged(frame(spark, rows)).collect())) == sorted(
        repr(r) for r in spark.createDataFrame(plain_damage(rows), "conv_id long, turn long, role string, text string").collect())


def test_empty_table(spark):
    fixed = repair(frame(spark, []))
    assert fixed.rows.count() == 0 and fixed.report.count() == 0
