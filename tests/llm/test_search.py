"""Lexical search: terms, strata and results against a plain version and the check SQL."""

import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm.conftest import EDGES, table
from squallbars.llm import CHECKS, QUERIES, lexical_index, lexical_search
from squallbars.llm.lexical_index import build_index, spaced, split_terms
from squallbars.llm.lexical_search import longest_of, search, spread

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k=10):
    """{item: [(doc, score), ...]} by scoring every document."""
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = {}
    merged = {}
    for item, text in items:
        merged.setdefault(item, set()).update(terms(text))
    for item, own in merged.items():
        found = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((d, score))
        if found:
            out[item] = sorted(found, key=lambda f: (-f[1], f[0] is None, f[0]))[:k]
    return out


def check(got, want):
    rows = {}
    for r in sorted(got, key=lambda r: r[1]):
        rows.setdefault(r[0], []).append(tuple(r[1:]))
    assert rows == {i: [(k + 1, d, s) for k, (d, s) in enumerate(w)] for i, w in want.items()}


def test_terms():
    texts = ["Äbc DEF-9_x y\x00z", "", " ... ", "é😀ß İ", "a" * 50, "{x}~|`[^]"]
    parents, found = split_terms(spaced(pa.array(["skipped", *texts]).slice(1)))
    assert list(zip(parents.tolist(), found.to_pylist())) == [(i, t) for i, text in enumerate(texts) for t in terms(text)]


def test_spread():
    assert spread(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_longest_of_a_normaliser():
    for docs, total in ((7, 93), (1, 1), (1000, 5_000_003)):
        lengths = {}
        for n in range(1, 400):
            lengths[10 + 90 * n * docs // total] = n
        for m, n in list(lengths.items())[:-1]:
            assert longest_of(m, docs, total) == n


def made(seed):
    deal = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "x1", "É", "THE"]
    weights = [1 / (i + 1) for i in range(len(words))]
    line = lambda n: deal.choice([" ", ", ", "\n", "--"]).join(deal.choices(words, weights, k=n))
    docs = [(i, line(deal.choice([1, 2, 3, 7, 20, 20, 20, 150]))) for i in range(700)] + [(i % 5, "w1 w2 copied") for i in range(200)] + [(None, "w50 w51"), (800, None), (801, "?!"), (802, line(40_000))]
    items = [(i, line(deal.choice([1, 4, 12, 30]))) for i in range(40)] + [(40, None), (41, "unknown"), (42, ""), (3, "w59 w58"), (None, "w50 over")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_search_against_plain(spark, monkeypatch, small):
    """With slices and blocks as in production, and so small that there are many."""
    docs, items = made(4 + small)
    if small:
        monkeypatch.setattr(lexical_index, "SLICE_TERMS", 40)
        monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 50)
        monkeypatch.setattr(lexical_search, "FIRST", 2)
    frame = spark.createDataFrame([(*d, 1, "m", 2, "t") for d in docs], "doc_id long, text string, n int, m string, slice int, term string").repartition(6)
    asked = spark.createDataFrame([(*i, 1, "m") for i in items], "item_id long, text string, query int, term string")
    check(search(build_index(frame), asked).collect(), plain(docs, items))


def test_slices_hold_one_stratum(spark, monkeypatch):
    docs, _ = made(9)
    rows = build_index(spark.createDataFrame(docs, "doc_id long, text string")).rows.collect()
    heads = {r.slice: r for r in rows if r.term == ""}
    assert sorted(x for h in heads.values() for x in h.ids if x is not None) == sorted(d for d, t in docs if terms(t) and d is not None)
    got, want = Counter(), Counter()
    for r in rows:
        if r.term:
            assert r.m == heads[r.slice].m and r.n == len(r["at"])
            got.update((r.term, heads[r.slice].ids[a], r.tf) for a in r["at"])
    for d, t in docs:
        want.update((w, d, n) for w, n in Counter(terms(t)).items())
    assert got == want


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = QUERIES["op13_lexical_search"](spark, sf_dir)
    check(got.select("item_id", "rank", "doc_id", "score").collect(), plain(docs, items))
    from compare import connect, rows

    assert rows(got.toPandas()) == rows(connect(sf_dir).execute(CHECKS["op13_lexical_search"]).df())


def test_odd_and_empty_tables(spark, edges, empty):
    items = [(1, "one four words"), (2, "é😀 and"), (3, None)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    check(search(build_index(edges), asked).collect(), plain([(d, t) for d, t, *_ in EDGES], items))
    assert search(build_index(empty), asked).count() == 0
    assert search(build_index(edges), asked.limit(0)).count() == 0
    assert search(build_index(table(spark, [(1, None, "en", "a"), (2, "?!", "en", "a")])), asked).count() == 0
