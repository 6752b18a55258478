"""Sums over segmentations against enumeration; predictions on held-out rows and odd ones."""

import numpy as np
import public_tokenizers
import pytest

from squallbars.llm.language_id import predict, public_pieces, train, words
from squallbars.llm.language_queries import document_model, held_out
from squallbars.llm.piece_lattice import Lattice


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or (n == 1 and word[0] not in pieces):
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_sums_equal_enumeration():
    rng = np.random.default_rng(4)
    pieces = ["a", "b", "ab", "ba", "aba", "bb", "abab", "c"]
    p = rng.random((len(pieces) + 1, 3))
    lattice = Lattice(pieces)
    samples = ["a", "abab", "bbabab", "cabq", "q", "abaqab", "ab" * 20]
    got = lattice.log_likelihood(samples, p)
    at = {x: i for i, x in enumerate(pieces)}
    for w, row in zip(samples[:6], got, strict=False):
        want = sum(np.prod([p[at.get(x, len(pieces))] for x in s], axis=0) for s in segmentations(w, at))
        assert np.allclose(np.exp(row), want)
    uses = lattice.expected(samples[:6], np.arange(1.0, 7.0), p[:, 0])
    want = np.zeros(len(pieces) + 1)
    for n, w in enumerate(samples[:6], 1):
        weights = [(np.prod([p[at.get(x, len(pieces)), 0] for x in s]), s) for s in segmentations(w, at)]
        for q, s in weights:
            for x in s:
                want[at.get(x, len(pieces))] += n * q / sum(v for v, _ in weights)
    assert np.allclose(uses, want)


def test_long_words_do_not_vanish():
    lattice = Lattice(["a", "b", "ab"])
    p = np.full((4, 2), 1e-6)
    p[:, 1] = 1e-5
    assert np.isfinite(lattice.log_likelihood(["ab" * 2_000], p)).all()


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return document_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_held_out_rows(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(held_out())
    rows = predict(docs, model).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(edges, empty, model):
    got = {(r.doc_id, r.text): r for r in predict(edges, model).collect()}
    for (_, text), r in got.items():
        assert (r.lang_pred == "und") == (not words(text or "")) and (r.score == 0) == (r.lang_pred == "und")
    assert predict(empty, model).count() == 0
    none = train(empty.select("text", "lang"), public_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    assert {r.lang_pred for r in predict(edges, none).collect()} == {"und"}
