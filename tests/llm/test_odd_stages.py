"""Odd rows in the pipeline's stages and the joins that send few texts; op2 and op4 against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vantidal.llm import mixing, quality
from vantidal.llm.common import asked_for, documents, is_held_out, without

TEN = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark, sf):
    """The table with nulls in every column, an empty and a very long text, repeated rows and ids, and further columns."""
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = [
        (None, "the one of the and", "en", "a", 18), (None, None, None, None, None), (9001, None, "en", "a", 0), (9002, "", "en", None, 0), (9003, "word and the " * 120_000, None, "b", 1_560_000),
        (9004, "one text of an id and of no other row here", "en", "a", 42), (9004, "quite another text with the same id as that one", "de", "b", 47), (9005, "a row that repeats " * 3, "en", "a", 57),
        (9005, "a row that repeats " * 3, "en", "a", 57), (9006, "  \t\n", "xx", "", 4),
    ]
    extra = spark.createDataFrame(rows, base.schema)
    return base.unionByName(extra).selectExpr("*", "'q' AS text_", "1 AS id", "2 AS score", "3 AS __score", "4 AS k", "5 AS draw", "6 AS copies", "7 AS kept", "8 AS n", "9 AS c0", "10 AS tokens")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf, odd, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, odd, sf)
    rows = out.collect()
    if name in ("pii", "bpe"):
        assert len(rows) == odd.count()
    if name != "bpe":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    if name == "near_dedup":
        ids = [r.doc_id for r in rows]
        assert ids.count(None) == 2 and ids.count(9004) == 2 and ids.count(9005) == 1 and {9001, 9002, 9003, 9006} <= set(ids)


def test_repeated_ids_are_documents_of_their_own(spark, sf):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (2, words + " x"), (2, "something else altogether that nobody repeats anywhere"), (3, "p q r s t u v"), (3, "p q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    got = sorted((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf).collect())
    assert [i for i, _ in got] in ([1, 2, 3], [2, 2, 3]) and sum(t.startswith("something") for _, t in got) == 1 and sum(t.startswith("w0 w1") for _, t in got) == 1


def test_few_texts_are_sent(spark):
    docs = spark.range(5000).select(F.col("id"), F.concat(F.lit("t"), "id").alias("text")).union(spark.createDataFrame([(None, "none")], "id long, text string"))
    ids = spark.range(0, 5000, 50).select("id")
    asked = asked_for(docs, ids)
    assert {r.id for r in asked.collect()} >= set(range(0, 5000, 50)) and asked.count() < 130 and asked.columns == docs.columns
    rest = without(docs, ids, "id").collect()
    assert len(rest) == 4901 and {r.id for r in rest} == {None, *(i for i in range(5000) if i % 50)}
    assert asked_for(docs, ids.limit(0)).count() == 0 and without(docs, ids.limit(0), "id").count() == 5001
    strings = docs.select(F.col("id").cast("string").alias("id"), "text")
    assert without(strings, ids.select(F.col("id").cast("string").alias("id")), "id").count() == 4901


def test_quality_query_equals_scoring_text_by_text(spark):
    """op2's rows against features computed word by word and the network's formula."""
    m = quality.Model()
    docs = documents(spark, TEN)
    table, net = quality.learn(docs, spark.read.parquet(f"{TEN}/labels.parquet"), m)
    got = {r.doc_id: r for r in corpus_query(spark).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[::23]:
        core, shape, counts = quality.unit_cells([r.text.encode()], m.cells)
        n, x = int(counts[0]), []
        for unit in (core, shape):
            v = table[unit].astype(float)
            x += [*v.mean(axis=0), *np.sqrt(np.maximum((v * v).mean(axis=0) - v.mean(axis=0) ** 2, 0))]
        pairs = {(a, b) for a, b in zip(core.tolist(), core.tolist()[1:], strict=False)}
        x += [len(set(core.tolist())) / n, len(set(shape.tolist())) / n, sum(a == b for a, b in zip(core, core[1:], strict=False)) / max(n - 1, 1), len(pairs) / (n - 1) if n > 1 else 1.0, np.log1p(n) / 10]
        z = (np.array(x) - net.mean) / net.scale
        logit = float(np.maximum(z @ net.w1 + net.b1, 0) @ net.w2 + net.b2) / net.temperature
        w = n * n / (n * n + net.trust)
        score = 1 / (1 + np.exp(-np.clip(w * logit + (1 - w) * net.prior, -60, 60)))
        assert abs(got[r.doc_id].score - score) < 1e-3 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def corpus_query(spark):
    from vantidal.llm import registry

    return registry.QUERIES["op2_quality"](spark, TEN)


def test_mixing_query_meets_its_targets(spark):
    """op4: token totals of rates and of copies against the targets, rates against a plain loop over documents."""
    from vantidal.llm import registry

    rows = registry.QUERIES["op4_mixing"](spark, TEN).collect()
    names = sorted(mixing.LANGUAGES)
    post, w, r, c = (np.array([x[k] for x in rows], float) for k in ("post", "tokens", "rate", "copies"))
    assert len(rows) == spark.read.parquet(f"{TEN}/documents.parquet").count() and post.shape[1] == len(names) == 5
    total = w.sum()
    now = (w @ post) / total
    target = now.copy()
    unit = now[names.index("en")] / mixing.LANGUAGES["en"]
    for i, n in enumerate(names):
        target[i] = mixing.LANGUAGES[n] * unit
    rated, copied = ((w * r) @ post) / total, ((w * c) @ post) / total
    clean = [i for i, n in enumerate(names) if n != "toxic"]
    assert np.abs(rated - target)[clean].max() < 0.02 and rated[names.index("toxic")] < 0.5 * now[names.index("toxic")]
    assert np.abs(copied - rated).max() < 0.03 and (np.abs(c - r) < 1).all()
    # Plain projected gradient on all documents, without groups, from the same posteriors.
    second = (post * w[:, None]).T @ post / total
    largest, history, gap = np.linalg.eigvalsh(second).max(), [], now - target
    for _ in range(60):
        if np.abs(gap).max() <= 1e-4:
            break
        history.append(np.round(gap / largest, 12))
        before, gap = gap, (w * mixing.rates_of(post, history)[1]) @ post / total - target
        if np.abs(gap - before).max() <= 1e-5:
            break
    assert np.allclose(mixing.rates_of(post, history)[0], r, atol=2e-3)


def test_held_out_rows(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, None)], "doc_id long")
    assert df.filter(is_held_out(F.col("doc_id"))).filter("doc_id IS NULL").count() == 1
