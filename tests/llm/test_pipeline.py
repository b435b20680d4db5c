"""The pipeline and the registered queries on the smallest tables."""

import os

import pytest
from conftest import DATA, against_sql

import corpus_pipeline
from foliant.llm import registry


@pytest.fixture(scope="module")
def staged(spark):
    from foliant.llm.common import stored, table

    out, docs = [table(spark, DATA, "documents")], table(spark, DATA, "documents")
    for name, f in corpus_pipeline.STAGES:
        out.append(docs := stored(f(spark, docs, DATA), name))
    return out


def test_stages_keep_columns_and_take_effect(spark, staged):
    docs = staged[0]
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in staged]
    for before, after in zip(ids, ids[1:], strict=False):
        assert after <= before
    for d in staged[1:-1]:
        assert sorted(d.dtypes) == sorted(docs.dtypes)
    assert ids[1] < ids[0] and ids[2] < ids[1] and ids[4] == ids[3] and ids[5] == ids[4]


def test_stages_equal_their_operators(spark, staged):
    from foliant.llm import decontaminate, near_dup, pii, quality_lm
    from foliant.llm.common import table

    kept = {r.doc_id for r in quality_lm.classify(staged[0], table(spark, DATA, "labels")).where("kept").collect()}
    assert kept == {r.doc_id for r in staged[1].collect()}
    assert {r.doc_id for r in near_dup.classes(staged[1]).where("kept").collect()} == {r.doc_id for r in staged[2].collect()}
    leaks = {r.doc_id for r in decontaminate.search(staged[2], table(spark, DATA, "benchmark")).collect()}
    assert {r.doc_id for r in staged[3].collect()} == {r.doc_id for r in staged[2].collect()} - leaks
    weights = pii.trained()
    before = {r.doc_id: r.text for r in staged[3].collect()}
    assert {r.doc_id: r.text for r in staged[4].collect()} == {k: pii.masked(t, pii.all_spans(t, weights)[1]) for k, t in before.items()}


def test_first_stage_uses_every_trusted_document(spark, monkeypatch):
    from foliant.llm import quality_lm
    from foliant.llm.common import table

    train, limits, counted, held = quality_lm.train_shards, quality_lm.thresholds, [], []
    monkeypatch.setattr(quality_lm, "train_shards", lambda texts: (counted.append(texts.count()), train(texts))[1])
    monkeypatch.setattr(quality_lm, "thresholds", lambda scores, *more: (held.append(scores.count()), limits(scores, *more))[1])
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    corpus_pipeline.quality(spark, docs, DATA).count()
    assert counted[0] > 0 and held[0] > 0
    assert counted[0] + held[0] == docs.join(quality_lm.trusted(labels), "doc_id").count()


def test_run_equals_stages(spark, staged):
    assert sorted(corpus_pipeline.run(spark, DATA).collect()) == sorted(staged[-1].collect())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_registered_queries(spark, name):
    if name in registry.oracle_sql():
        ours, theirs = against_sql(spark, registry.queries()[name], registry.oracle_sql()[name])
        assert ours == theirs
    else:
        assert registry.queries()[name](spark, DATA).count() > 0


def test_nothing_outside_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for d, _, files in os.walk(os.path.join(root, "foliant")):
        if os.path.basename(d) != "llm":
            assert not any("foliant.llm" in open(os.path.join(d, f)).read() for f in files if f.endswith(".py"))
