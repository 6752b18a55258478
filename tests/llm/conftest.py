import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, node string, part string, key string, base string, lang_pred string, row string, _copies int, _copy int, _kept string, kept string, _language string, _posterior double, _id long, _source string, _size int"


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, la, s, None if t is None else len(t), "x", "y", "z", "p", "k", "b", "q", "r", 7, 8, "k", "kk", "xx", 0.25, 1, "s", 3) for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
EDGES = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, "one two three four five six", "en", "b"),
    (5, "one two three four five six", "en", "b"), (5, "one two three four five six", "en", "b"), (7, LONG, "de", None),
    (None, "no id here but some words and more", "fr", "c"), (9, "12345 678 !!", None, "c"), (10, "é😀 ß́ x", "de", "a"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return table(spark, EDGES)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
