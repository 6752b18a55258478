"""Language of texts by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum, over all its
segmentations into pieces, of the products of their probabilities (forward algorithm); a text's is the product over its
words, runs of letters in lower case. Piece probabilities are fitted by expectation maximisation on the words of a bounded
sample of labelled rows.

`predict` gives `und` and score 0 to texts that are null or have no letter, else the likeliest language and its posterior
(prior: shares of labels). Repeated rows are predicted alike; without labelled rows every text is `und`; an empty table
gives no rows; `text` and `lang` are the only inputs.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallbars.llm.common import CACHES, release, written
from squallbars.llm.piece_lattice import Lattice

BEGIN = "▁"
UNKNOWN = 1e-8
LONGEST_FITTED = 32
CACHED_WORDS = 400_000
_RUN = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return [w for w in _RUN.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def public_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece file, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    probability: np.ndarray
    """A row for each piece and one for letters without a piece, a column for each language."""
    prior: np.ndarray


def labelled_sample(rows: DataFrame, fit_rows: int, counts: dict[str, int]) -> DataFrame:
    """About `fit_rows` labelled rows of each language, chosen by a hash of their text; languages with fewer rows are whole.

    The shares (one number for each language) stand in the expression, so no text is dealt out by language.
    """
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, fit_rows / n)])
    chance = F.shiftrightunsigned(F.xxhash64("text"), 12) / float(1 << 52)
    return rows.filter(chance < F.element_at(shares, F.col("lang"))).select("text", "lang")


def train(rows: DataFrame, pieces: list[str], fit_rows: int = 1500, rounds: int = 3) -> LanguageModel:
    """Fit the piece probabilities to rows of (text, lang).

    `fit_rows` bounds the rows read for each language. Words are counted by Spark; each round sums expected uses of pieces
    (languages x vocabulary, a fixed size) over partitions of the word table.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    prior = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(prior)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    lattice = spark.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(_LATTICES)
        for batch in batches:
            seen = Counter((lang, w) for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)
                           for w in words(text) if len(w) <= LONGEST_FITTED)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                                              pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    table = written(labelled_sample(rows, fit_rows, prior).mapInArrow(count, "lang string, word string, n long")
                    .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    probability = np.full((len(pieces) + 1, len(languages)), 1.0 / max(1, len(pieces)))
    probability[-1] = UNKNOWN
    for _ in range(rounds):
        state = spark.sparkContext.broadcast(probability)

        def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            release(_LATTICES)
            walk = _lattice(lattice.value)
            total = np.zeros((walk.size + 1, len(languages)))
            for frame in frames:
                for lang, part in frame.groupby("lang"):
                    at = languages.index(lang)
                    total[:, at] += walk.expected([BEGIN + w for w in part["word"]], part["n"].to_numpy(float), state.value[:, at])
            piece, at = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "at": at, "uses": total[piece, at]})

        sums = table.mapInPandas(expect, "piece long, at long, uses double").groupBy("piece", "at").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.zeros_like(probability)
        uses[sums["piece"], sums["at"]] = sums["uses"]
        uses[-1] = 0
        uses += 1e-2
        probability = uses / uses.sum(0)
        probability[-1] = UNKNOWN
    weights = np.array([prior[x] for x in languages], float)
    return LanguageModel(languages, pieces, probability, weights / weights.sum())


_LATTICES: dict[int, Lattice] = {}


def _lattice(pieces: list[str]) -> Lattice:
    """One lattice per worker process and vocabulary."""
    key = hash((len(pieces), pieces[0], pieces[-1])) if pieces else 0
    if key not in _LATTICES:
        _LATTICES[key] = Lattice(pieces)
    return _LATTICES[key]


class Scorer:
    """Log-likelihoods of words in every language, each word computed once while the cache holds it."""

    def __init__(self, model: LanguageModel):
        self.model, self.walk = model, _lattice(model.pieces)
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        cut = [words(t or "") for t in texts]
        if len(self.place) > CACHED_WORDS:
            self.place, self.rows = {}, self.rows[:0]
        fresh = sorted(set().union(*cut).difference(self.place))
        if fresh:
            self.rows = np.vstack([self.rows, self.walk.log_likelihood([BEGIN + w for w in fresh], self.model.probability)])
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
        return [self._best(c) for c in cut]

    def _best(self, cut: list[str]) -> tuple[str, float]:
        if not cut or not self.model.languages:
            return "und", 0.0
        total = self.rows[np.fromiter(map(self.place.__getitem__, cut), np.int64, len(cut))].sum(0) + np.log(self.model.prior)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


_SCORERS: dict[str, Scorer] = {}
CACHES.extend([_LATTICES, _SCORERS])


def _scorer(key: str, model: LanguageModel) -> Scorer:
    """One scorer per worker process and model."""
    if key not in _SCORERS:
        release(_LATTICES)
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of `docs` with the predicted language and its score, in place of columns so named; all other columns stay."""
    docs = docs.drop(*names)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = scorer.score(some.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                                 [*some.schema.names, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(label, f"{kept}, `{names[0]}` string, `{names[1]}` double")
