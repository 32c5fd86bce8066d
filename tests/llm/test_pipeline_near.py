"""The pipeline's near_dedup stage, as STAGES runs it, against brute force at five words and 0.8."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_near_dedup import corpus


def kept_at(rows, percent):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in ((i, t.lower().split()) for i, t in rows)}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return [i for i in ids if top(i) == i]


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    return sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect())


def test_stage_links_from_080(spark, sf):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(kept_at(table, 80)) < len(kept_at(table, 85))
    assert stage(spark, table) == kept_at(table, 80)


def test_stage_on_pairs_about_080(spark):
    rows, rng = corpus(3, copies=30), random.Random(9)
    for n in range(40):  # a text and a copy with some words replaced, around 0.8
        base = [f"p{rng.randrange(10**6)}" for _ in range(120)]
        copy = list(base)
        for k in range(rng.choice((1, 2, 3, 4))):
            copy[20 + 25 * k] = f"q{rng.randrange(10**6)}"
        rows += [(1000 + 2 * n, " ".join(base)), (1001 + 2 * n, " ".join(copy))]
    assert len(kept_at(rows, 80)) < len(kept_at(rows, 85))
    assert stage(spark, rows) == kept_at(rows, 80)
