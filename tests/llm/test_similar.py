"""Similarity join, vectors and components against brute force."""

import math
import random

import numpy as np
import pytest

from squallbars.llm.components import components
from squallbars.llm.near_vectors import vector_groups
from squallbars.llm.ngram_join import join_similar, keep_one
from squallbars.llm.shingles import least_matches, overlaps, shingles


def classes(ids, linked):
    """Least id reached and number of links of each position."""
    n = len(ids)
    at = list(range(n))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                at[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least.get(top(i)) for i in range(n)], links


def edited(rng, words, share):
    out = list(words)
    for k in rng.sample(range(len(out)), int(len(out) * share)):
        out[k] = f"new{rng.randint(0, 10**6)}"
    return out


@pytest.fixture(scope="module")
def similar(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(8):
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(60, 200))]
        texts += [" ".join(edited(rng, words, s)) for s in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)]
    hot = [f"h{rng.randint(0, 500)}" for _ in range(120)]
    texts += [" ".join(edited(rng, hot, 0.017)) for _ in range(40)] + [None, "", "  ", "a b c", "a b c", "A B  c"]
    rng.shuffle(texts)
    return texts


def test_join(spark, similar):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(similar)], "doc_id long, text string, node string")
    sets = [set((t or "").lower().split()[k:k + 5].__str__() for k in range(max(1, len((t or "").split()) - 4))) if (t or "").split() else set() for t in similar]
    want = classes(list(range(len(sets))), lambda i, j: bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)
    got = {r.doc_id: r for r in join_similar(docs).collect()}
    assert [(got[i].class_id, got[i].n_links) for i in range(len(sets))] == list(zip(*want, strict=True))
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_join_in_small_blocks(spark, similar, monkeypatch):
    from squallbars.llm import ngram_join

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(similar)], "doc_id long, text string")
    whole = {r.doc_id: (r.class_id, r.n_links) for r in join_similar(docs).collect()}
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    assert {r.doc_id: (r.class_id, r.n_links) for r in join_similar(docs).collect()} == whole


def test_join_of_odd_rows(edges, empty):
    rows = join_similar(edges).collect()
    assert len(rows) == edges.count()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in rows if r.doc_id in (4, 5)) == [(4, 4, 2), (5, 4, 2), (5, 4, 2)]
    assert all(r.n_links == 0 for r in rows if r.doc_id not in (4, 5))
    assert join_similar(empty).count() == 0
    kept = keep_one(edges)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 2


def test_shingles():
    assert len(shingles(None)) == len(shingles(" \n")) == 0
    assert len(shingles("a b")) == 1 and (shingles("a b") == shingles("A\tB ")).all()
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b c d e " * 10)) == 5
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 25).astype(np.uint64)) for _ in range(9)]
    both = overlaps(sets, np.arange(5), np.arange(3, 9), together=4)
    assert (both == [[len(set(sets[i].tolist()) & set(sets[j].tolist())) for j in range(3, 9)] for i in range(5)]).all()


def test_stop_rule_is_the_posterior():
    need = least_matches(0.8, 1e-6, 32)
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n in (8, 32):
        for m in range(n + 1):
            density = grid**m * (1 - grid) ** (n - m)
            assert (density[grid >= 0.8].sum() / density.sum() >= 1e-6) == (m >= need[n])


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [b + rng.normal(size=16) * s for b in base for s in (0, 0.05, 0.12, 0.2)] + [base[0]] * 3 + [base[1] * 7.5]
    hot = rng.normal(size=16)
    rows += [hot + rng.normal(size=16) * 0.1 for _ in range(60)]
    vectors = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    n = len(vectors)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] + [0.0] * 15]
    vectors += [(n + k, o) for k, o in enumerate(odd)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, id string, copies int")
    unit = [np.array(v) / np.linalg.norm(v) if k < n else None for k, (_, v) in enumerate(vectors)]
    want = classes(list(range(len(unit))), lambda i, j: unit[i] is not None and unit[j] is not None and unit[i] @ unit[j] >= 0.95)
    exact = {r.vec_id: r for r in vector_groups(df, cell_size=40, block=16, reach=4.0).collect()}
    assert [(exact[i].component_id, exact[i].n_links) for i in range(len(unit))] == list(zip(*want, strict=True))
    assert all(r.kept == (r.vec_id == r.component_id) for r in exact.values())
    assert vector_groups(df.limit(0)).count() == 0


def test_recall_over_the_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.collect()
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = int((unit @ unit.T >= 0.95).sum()) - len(rows)
    got = vector_groups(table, cell_size=20).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * true <= got <= true


def test_no_link_is_lost_at_cell_borders(spark):
    rng = np.random.default_rng(8)
    rows = np.zeros((5000, 64))
    rows[:, :4] = rng.normal(size=(5000, 4))  # differences in few directions, twelve cells
    vectors = [(i, [float(x) for x in r]) for i, r in enumerate(rows)] + [(6000, [1.0] * 400)]
    unit = np.zeros((5001, 400))
    unit[:5000, :64], unit[5000] = rows, 1
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    got = {r.vec_id: r.n_links for r in vector_groups(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i, _ in vectors] == (near.sum(1) - 1).tolist()


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100 + rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(40)] + [(500, k) for k in range(501, 560)] + [(9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    pairs = {frozenset(e) for e in edges}
    want, _ = classes(nodes, lambda i, j: frozenset((nodes[i], nodes[j])) in pairs)
    assert got == dict(zip(nodes, want, strict=True))
    assert math.isclose(len(got), len(nodes))


def test_components_that_have_not_settled_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "src long, dst long")
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)
