"""Repeated byte strings against brute force; runs and anchors."""

import random
from collections import Counter

import numpy as np
import pytest

from squallbars.llm import suffix_anchors, suffix_dedup
from squallbars.llm.suffix_anchors import Sums, anchors
from squallbars.llm.suffix_dedup import remove_repeats
from squallbars.llm.suffix_runs import encode_run, merge_runs, shared


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, int)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i + 1:i + length + 1] = 1
        edges = np.flatnonzero(np.diff(gone))
        out.append((len(r), [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)], bytes(b for b, g in zip(r, gone[1:-1], strict=True) if not g)))
    return out


def texts_with_repeats(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    passages = [make(rng.randint(length // 12, length // 2)) for _ in range(6)]
    texts = [make(rng.randint(0, 60)) + "".join(rng.choice(passages) + make(rng.randint(0, 9)) for _ in range(rng.randint(0, 3))) for _ in range(40)]
    texts += [texts[0], texts[1], texts[1] + "x", "y" + texts[2], None, "", "ab" * length, "a" * (length + 5), passages[0] * 3, passages[1][:length // 2]]
    return texts


@pytest.mark.parametrize(("seed", "per_range"), [(1, 40_000), (2, 60), (3, 9)])
def test_equals_brute_force(spark, monkeypatch, seed, per_range):
    """With small ranges, classes and equal strings reach over several of them."""
    length = 90
    monkeypatch.setattr(suffix_dedup, "PER_RANGE", per_range)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    texts = texts_with_repeats(seed, length)
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(5)
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in remove_repeats(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_sample_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = remove_repeats(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    want = brute([r.text for r in rows], 400)
    assert [(r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows] == want


def test_odd_rows(edges, empty):
    rows = {(r.doc_id, r.n_bytes): r for r in remove_repeats(edges).collect()}
    assert sum(len(r.spans) for r in rows.values()) <= 1  # the long text repeats itself
    assert remove_repeats(empty).count() == 0


def test_anchors_depend_on_windows_alone(monkeypatch):
    monkeypatch.setattr(suffix_anchors, "_SLICE", 50)
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 100, 700).astype(np.uint8)
    place, first, last, _ = anchors(raw, 90, Sums(raw, 0))
    by_window = np.zeros(700 - 90 + 1, int)
    for p, a, b in zip(place, first, last, strict=True):
        by_window[a:b + 1] = p
    for s in range(0, 611, 13):
        part = raw[s:s + 90].copy()
        assert anchors(part, 90, Sums(part, 0))[0].tolist() == [by_window[s] - s]


def test_merging_runs():
    rng = random.Random(5)
    for _ in range(150):
        letters = rng.choice([b"ab", b"abc", b"abcdefgh"])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([3, 12, 40])))) for _ in range(rng.randint(0, 60))]
        parts = [[] for _ in range(rng.randint(1, 7))]
        for i, s in enumerate(strings):
            rng.choice(parts).append((s, i))
        out = list(merge_runs([encode_run([s for s, _ in sorted(p)], [i for _, i in sorted(p)]) for p in parts]))
        assert [s for s, _, _ in out] == sorted(strings) and sorted(i for *_, i in out) == list(range(len(strings)))
        assert all(b[1] == shared(a[0], b[0]) for a, b in zip(out[:-1], out[1:], strict=True))


def test_groups_of_texts_give_each_texts_own_anchors():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (300, 90, 5, 0, 700, 89, 91)]
    ends, raw = np.cumsum([len(t) for t in texts]), np.concatenate(texts)
    want = [(int(p + at), int(a + at), int(b + at)) for t, at in zip(texts, ends - [len(t) for t in texts], strict=True) for p, a, b in zip(*anchors(t, 90, Sums(t, 0))[:3], strict=True)]
    assert list(zip(*(x.tolist() for x in anchors(raw, 90, Sums(raw, 0), ends)[:3]), strict=True)) == want


def test_classes_inside_a_range_are_settled_there():
    """Each row against all others: offsets from `least` to `most` that another row shares on both sides."""
    rng, length, rows = random.Random(6), 90, 60
    sides = [sorted((bytes(rng.choice(b"ab") for _ in range(3)) + b"x" * rng.choice([0, 20, 40, 84]) + bytes(rng.choice(b"ab") for _ in range(9)), i) for i in range(rows)) for _ in range(2)]
    share = [{}, {}]
    lists = []
    for side, strings in enumerate(sides):
        leaf, nodes = suffix_dedup.class_tree(0, [], [0, *(shared(a[0], b[0]) + 1 for a, b in zip(strings[:-1], strings[1:], strict=True))], [])
        chains = {i: suffix_dedup._chain(nodes, x, 1) for (_, i), x in zip(strings, leaf, strict=True)}
        assert all(len(d) == k for d, _, k in chains.values())
        lists.append(tuple(np.array(v, np.int64) for v in ([x for i in range(rows) for x in chains[i][0]], [x for i in range(rows) for x in chains[i][1]], np.cumsum([0, *(len(chains[i][0]) for i in range(rows))]))))
        share[side] = {(i, j): shared(a, b) for a, i in strings for b, j in strings if i != j}
    least, most, inside = np.full(rows, 3), np.full(rows, 70), np.diff(lists[0][2])
    got = [set() for _ in range(rows)]
    for row, a, b in zip(*suffix_dedup.settled_offsets(lists[0], lists[1], least, most, inside, length), strict=True):
        got[row].update(range(a, b + 1))
    want = [{o for j in range(rows) if j != i for o in range(max(3, length - share[0][i, j]), min(70, share[1][i, j]) + 1)} for i in range(rows)]
    assert got == want and any(want)


def test_class_chains_are_never_broadcast(spark, monkeypatch):
    """The planner guesses the size of what Python returns: however small it looks, it is dealt."""
    length, plans, write = 90, {}, suffix_dedup.written

    def planned(df, name, **options):
        if name == "class-pairs":
            df.collect()  # adaptive execution has its last word
            plans[name] = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
        return write(df, name, **options)

    monkeypatch.setattr(suffix_dedup, "written", planned)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_with_repeats(1, length))], "doc_id long, text string")
    assert remove_repeats(docs, length).count() == docs.count()
    depth, sent = lambda line: len(line) - len(line.lstrip(" :|+-*")), None
    chains = []
    for line in plans["class-pairs"]:
        sent = None if sent is not None and depth(line) <= sent else sent
        if "BroadcastExchange" in line and sent is None:
            sent = depth(line)
        if "MapInArrow" in line and "chains(" in line:
            chains.append(sent)
    assert chains == [None, None]


def test_a_frequent_passage_is_dealt_to_many_ranges(spark, monkeypatch):
    """Places of one passage in many texts are cut like any other strings, not kept in one range."""
    length, orders, write = 90, [], suffix_dedup.written

    def kept(df, name, **options):
        out = write(df, name, **options)
        orders.extend([out] * (name == "order"))
        return out

    monkeypatch.setattr(suffix_dedup, "written", kept)
    monkeypatch.setattr(suffix_dedup, "PER_RANGE", 200)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 8)
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = make(120)
    texts = [make(rng.randint(30, 150)) + passage + make(rng.randint(30, 150)) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in remove_repeats(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)
    sizes = [r["size"] for r in orders[0].select("size").collect()]
    assert sum(sizes) > 1000 and max(sizes) <= 800


def test_cuts_keep_right_classes_whole_unless_they_outgrow_a_range():
    rng = random.Random(8)
    make = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    small, large = make(80), make(80)
    strings = sorted({(b"R" + (small if i < 50 else large if i < 500 else make(90)) + make(20), i) for i in range(1000)} | {(b"L" + make(40), i) for i in range(1000)} | {(b"L" + large, i) for i in range(300)})
    found = suffix_dedup.cuts(strings, 20)
    sizes = np.diff([0, *(next(i for i, s in enumerate(strings) if s >= c) for c in found), len(strings)])
    assert found == sorted(found) and max(sizes) <= 3 * len(strings) / 20 + 1
    assert not any(c[0].startswith(b"R" + small[:64]) for c in found) and any(c[0].startswith(b"R" + large[:64]) for c in found)
    assert sum(c[0] == b"L" + large for c in found) >= 2 and suffix_dedup.cuts([], 3) == [] == suffix_dedup.cuts(strings[:1], 3)
