"""The pipeline's stages, each on what the one before kept."""

import re

import pytest

import corpus_pipeline
from squallbars.llm.ngram_join import join_similar
from squallbars.llm.private_patterns import base_spans


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test-stage")
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_language_keeps_clean_documents(stages):
    assert stages[1].count() >= 0.98 * stages[0].count()
    assert stages[1].subtract(stages[0]).count() == 0


def test_one_of_each_class_stays(stages):
    classes = join_similar(stages[1]).select("class_id").distinct().count()
    assert stages[2].count() == classes
    assert join_similar(stages[2]).filter("n_links > 0").count() == 0


def test_no_personal_data_is_left(stages):
    rows = stages[3].collect()
    assert len(rows) == stages[2].count()
    assert not any(any(base_spans(r.text or "").values()) for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)


def test_mix_repeats_documents(stages):
    size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    before, after = stages[3].collect(), stages[4].collect()
    assert abs(size(after) - size(before)) < 0.2 * size(before)
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}


def test_packing_takes_all(stages):
    packed = stages[5].toPandas()
    assert len(packed[packed.piece == 0]) == stages[4].count()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[5].count()


def test_entry_registers_all():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", ["edges", "empty"])
def test_stages_take_odd_tables(spark, request, name):
    docs = request.getfixturevalue(name)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, docs, ""), "test-odd")
        assert after.columns == docs.columns
        assert all((r["_copies"], r["_kept"], r["_language"], r["_posterior"], r["_id"]) == (7, "k", "xx", 0.25, 1) for r in after.collect())
        docs = after
    ids = {r.doc_id for r in docs.collect()}
    assert ids <= {4, 7, None, 10}  # 1 to 3 and 9 have no letters, both of 5 equal 4
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == ids
