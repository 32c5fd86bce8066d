"""Each stage of the pipeline against a brute-force version of what it should keep."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from tests.llm.test_near_dedup import brute
from vantidal.llm import bpe, mixing, near_dedup, pii

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_quality_keeps_clean_documents(spark, sf, docs):
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert len(ids & set(clean)) >= 0.97 * len(clean)
    assert len([i for i, q in labels.items() if q == 0 and i in ids]) <= 0.2 * sum(q == 0 for q in labels.values())


def test_near_dedup_keeps_one_of_each_group(spark, sf, docs):
    twice = docs.unionByName(docs.filter("doc_id = 3")).unionByName(docs.limit(1).selectExpr("CAST(NULL AS bigint) AS doc_id", "text", "lang", "source", "n_chars"))
    out = corpus_pipeline.near_dedup_stage(spark, twice, sf)
    want, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert out.columns == COLUMNS and sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(i for i, c in want.items() if i == c)
    assert out.filter("doc_id IS NULL").count() == 1


def test_pii_keeps_rows(spark, sf, docs):
    out = {r.doc_id: r for r in corpus_pipeline.pii_stage(spark, docs, sf).collect()}
    assert len(out) == docs.count()
    changed = 0
    for r in docs.collect():
        found = pii.detect(r.text)
        assert out[r.doc_id].n_chars == len(out[r.doc_id].text) and (out[r.doc_id].lang, out[r.doc_id].source) == (r.lang, r.source)
        assert not [e for e in found if e.value in out[r.doc_id].text]
        changed += out[r.doc_id].text != r.text
        if not found:
            assert out[r.doc_id].text == r.text
    assert changed


def test_mixing_follows_copies(spark, sf, docs):
    rates = {r.doc_id: r.copies for r in mixing.mix(docs, mixing.tones(spark.read.parquet(f"{sf}/labels.parquet")), mixing.TARGETS).collect()}
    out = corpus_pipeline.mixing_stage(spark, docs, sf)
    assert out.columns == COLUMNS
    got: dict = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in rates.items() if n}


def test_run_equals_the_stages_one_by_one(spark, sf, docs):
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "bpe":
            assert docs.columns == COLUMNS
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)
    want = sorted(tuple(r) for r in docs.collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want
    text = {r.doc_id: r.text for r in rows}
    assert all(r[3] == hashlib.sha256(text[r[0]].encode()).hexdigest() for r in want) and len(want) == len(rows)


def test_stages_on_empty_documents(spark, sf, docs):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_parts_are_the_operators():
    assert corpus_pipeline.near_dedup is near_dedup and corpus_pipeline.bpe is bpe and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mixing", "bpe"]
