from collections import defaultdict

import pytest

import corpus_pipeline
from marketloom.llm import catalog
from marketloom.llm.common import staged, table

DIR = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = table(spark, DIR, "documents")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in left.select("doc_id").collect()}
        left = staged(stage(spark, left, DIR))
        after = {r.doc_id for r in left.select("doc_id").collect()}
        assert after <= before and after, name
        if name != "best_fit_packing":
            assert left.columns == columns and len(after) < len(before), name
    assert after == before  # packing loses nothing
    whole = {tuple(r) for r in left.drop("sequence_id", "offset").collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, DIR).drop("sequence_id", "offset").collect()} == whole


def test_quality_keeps_good_and_drops_bad(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    by = defaultdict(list)
    for r in table(spark, "/root/testdata/sf0.01", "labels").join(docs, "doc_id").collect():
        if len(r.text.split()) >= 20:
            by[r.quality].append(r.doc_id in kept)
    assert sum(by[1]) / len(by[1]) > 0.99 and sum(by[0]) / len(by[0]) < 0.05


@pytest.mark.parametrize("at", range(4))
def test_odd_and_empty_tables(spark, odd_docs, no_docs, at):
    name, stage = corpus_pipeline.STAGES[at]
    for docs in (odd_docs, no_docs):
        out = stage(spark, docs, DIR)
        assert (out.columns == docs.columns or name == "best_fit_packing") and out.count() <= docs.count() + 20
    assert no_docs.count() == 0 and stage(spark, no_docs, DIR).count() == 0


def test_every_operator_has_one_query():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in catalog.QUERIES) == 1
    assert "pipeline" in catalog.QUERIES and set(catalog.SQL) <= set(catalog.QUERIES)
