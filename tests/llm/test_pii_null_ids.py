"""Rows with a null id share the surrogates of the other rows."""

from __future__ import annotations

from vantidal.llm import pii


def test_null_ids_get_the_redrawn_surrogate(spark):
    names = [f"{a}{b}" for a in "王李张刘陈杨" for b in "伟芳娜敏静丽强磊"]  # 48 names, 100 surrogates: some collide
    rows = [(i, f"Mr {n} said") for i, n in enumerate(names)] + [(None, f"Mr {n} said") for n in names]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.replace_entities(docs, b"vantidal").collect()
    assert len(out) == len(rows)
    assert sorted(r.text for r in out if r.doc_id is None) == sorted(r.text for r in out if r.doc_id is not None)
    assert len({r.text for r in out}) == len(names)
