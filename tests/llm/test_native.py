"""Fingerprints and mixing: results against brute force, plans without Python."""

import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from squallbars.llm.fingerprints import BLOCK, combined, difference, differing, entries, fingerprints, folded, long, sketch
from squallbars.llm.mixing import WORD, mix, source_targets

PYTHON = re.compile("Python|Pandas|Arrow", re.I)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def blocks(text):
    return {line[i:i + BLOCK] for line in text.split("\n") for i in range(0, len(line), BLOCK)}


def alike(a, b):
    a, b = blocks(a), blocks(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(docs):
    rows = fingerprints(docs).collect()
    given = sorted({(r.doc_id, r.text or "") for r in docs.collect()}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(given) == len({i for i, _ in given})
    after = {i: (t, given[(k + 1) % len(given)][1]) for k, (i, t) in enumerate(given)}
    prints = {}
    for r in rows:
        text, following = after[r.doc_id]
        half = len(text) // 2
        new = text[:len(text) - half] + following[:half]
        assert (r.n_chars, r.edited) == (len(text), new)
        assert r.near_edited == pytest.approx(alike(text, new)) and r.near_next == pytest.approx(alike(text, following))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(rows) == docs.count()


def test_fingerprints(spark, sf_dir):
    check_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_fingerprints_of_odd_rows(edges, empty):
    check_fingerprints(edges)
    assert fingerprints(empty).count() == 0


def test_fingerprints_run_without_python(edges):
    assert not PYTHON.search(plan(fingerprints(edges)))


def test_sketches_recover_differences(spark):
    """Differences of many sizes, most too large for the first sketch."""
    rows = [(list(range(0, a)), list(range(a - c, a - c + b))) for a in (0, 1, 5, 60, 400) for b in (0, 3, 90, 700) for c in (0, 2, 40) if c <= min(a, b)]
    df = spark.createDataFrame([(x, y) for x, y in rows], "a array<long>, b array<long>")
    w = long(8)
    cells = lambda c: sketch(F.transform(c, lambda x: F.xxhash64(x)), w)
    one, other = (F.transform(c, lambda x: F.xxhash64(x)) for c in ("a", "b"))
    got = df.select("a", "b", one.alias("one"), other.alias("other"), differing(one, other, difference(cells("a"), cells("b")), w).alias("d"), F.size(difference(cells("a"), cells("a"))).alias("none")).collect()
    for r in got:
        assert r.none == 0 and set(r.d.found.one) == set(r.one) - set(r.other) and set(r.d.found.other) == set(r.other) - set(r.one)
        assert len(r.d.found.one) + len(r.d.found.other) == len(set(r.a) ^ set(r.b))
    sums = df.select(F.aggregate(combined(entries(one, w, 1)), long(0), lambda n, c: n + c["n"]).alias("n"), F.size("a").alias("m")).collect()
    assert all(r.n == 3 * r.m for r in sums)
    folds = df.select(folded(sketch(one, long(64)), long(64), w).alias("folded"), cells("a").alias("built")).collect()
    assert all(r.folded == r.built for r in folds)


def spark_hash(value, *more):
    """The 64-bit digest of a long and what follows, as the DataFrame function has it."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", value), seed=42)
    for m in more:
        h = xxhash.xxh64_intdigest(m.encode() if isinstance(m, str) else struct.pack("<i", m), seed=h)
    return h - (1 << 64) if h >> 63 else h


def cells_of(text):
    w, n, cells = text.split(";")
    signed = lambda x: int(x, 16) - (1 << 64) if int(x, 16) >> 63 else int(x, 16)
    split = [c.split(":") for c in cells.split(",") if c]
    return int(w), int(n), {int(c, 16): (int(m), signed(k), signed(h)) for c, m, k, h in split}


def test_two_returned_fingerprints_alone_peel_to_the_differing_digests(spark, sf_dir):
    peeled = 0
    for r in fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).limit(400).collect():
        (w, n, one), (v, m, other) = cells_of(r.fingerprint), cells_of(r.edited_fingerprint)
        if w != v or r.cells != w:
            continue
        left = {c: tuple(f(a, b) for f, a, b in zip((int.__sub__, int.__xor__, int.__xor__), one.get(c, (0, 0, 0)), other.get(c, (0, 0, 0)), strict=True)) for c in {*one, *other}}
        found = {}
        while pure := [c for c in left.values() if abs(c[0]) == 1 and spark_hash(c[1], "check") == c[2]]:
            sign, k, h = pure[0]
            found[k] = sign
            for t in range(3):
                c = t * w + spark_hash(k, t) % w
                left[c] = (left[c][0] - sign, left[c][1] ^ k, left[c][2] ^ h)
        assert not any(any(c) for c in left.values())
        assert ({k for k, s in found.items() if s == 1}, {k for k, s in found.items() if s == -1}) == (set(r.removed), set(r.added))
        assert r.near_edited == pytest.approx((n + m - len(found)) / (n + m + len(found)) if n + m else 1.0)
        peeled += 1
    assert peeled >= 100


def levels(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)


def check_mix(docs, tolerance):
    rows = mix(docs).collect()
    texts = docs.collect()
    assert len(rows) == len(texts)
    sizes = {}
    for r in texts:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(WORD, r.text or ""))
    want = levels(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(largest[s], 1) * tolerance, s
    return sorted((str(r.doc_id), r.size, r.taken) for r in rows)


def test_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert check_mix(docs, 0.51) == check_mix(docs.repartition(7), 0.51)


def test_mix_with_targets_at_the_limit(spark):
    rows = [(i, "w " * (1 + i % 17), f"s{min(i // 3, 3)}") for i in range(200)] + [(900, "", "empty"), (901, None, None), (902, "a b c", None)]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.51)


def test_mix_of_odd_rows(edges, empty, spark):
    check_mix(edges, 1.01)
    assert mix(empty).count() == 0
    check_mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string"), 1)
    assert not PYTHON.search(plan(mix(edges)))


def test_rates_tilt_with_size(spark):
    rows = [(i, "w " * (1 + i % 40), "a" if i < 300 else "b") for i in range(400)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1))
    by = {(r.source, r.size): r.rate for r in got.collect()}
    odds = {k: r / (3 - r) * 2 for k, r in by.items()}
    for s in "ab":  # the odds are an exponential of the size
        assert odds[s, 20] ** 2 == pytest.approx(odds[s, 10] * odds[s, 30])


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 50, "": 0}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, documents long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(levels(sizes))
