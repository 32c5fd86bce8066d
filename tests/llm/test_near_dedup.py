"""Near duplicates against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from vantidal.llm import near_dedup as nd


def brute(rows):
    """(id -> least id reachable, number of links) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, links = sorted(sets), 0
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(s and t and 100 * len(s & t) >= 85 * len(s | t) for s in sets[a] for t in sets[b]):
                links += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}, links


def edited(rng, base, k):
    out = list(base)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def corpus(seed, copies=50):
    """Copies of a text whose edits put many pairs just below and above the threshold, chains, and strangers."""
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(3):
        base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(copies):
            rows.append((n := n + 1, " ".join(edited(rng, base, rng.choice((1, 2, 3, 4, 5))))))
        chain = base
        for _ in range(10):
            chain = edited(rng, chain, 2)
            rows.append((n := n + 1, " ".join(chain)))
    for _ in range(30):
        rows.append((n := n + 1, " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60)))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 7)])
def test_all_links_count(spark, seed, block):
    rows = corpus(seed)
    want, links = brute(rows)
    assert links > 200 and len(set(want.values())) > 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(df, nd.Linking(block=block, fan=16)).collect()}
    assert got == want


@pytest.mark.parametrize("percent", [80, 95])
def test_exact_links_miss_none(spark, percent):
    """Buckets of prefixes: pairs at and around the threshold, down to sets of a few shingles."""
    rng = random.Random(percent)
    rows = [r for r in corpus(4, copies=20)]
    for n in range(120):
        size = rng.randrange(5, 60)
        base = [f"s{rng.randrange(10**6)}" for _ in range(size)]
        rows += [(10_000 + 2 * n, " ".join(base)), (10_001 + 2 * n, " ".join(base[: size - rng.randrange(0, 6)]))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in ((i, t.split()) for i, t in rows)}
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
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), nd.Linking(percent=percent, exact=True)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in ids}


def test_odd_rows(spark):
    rows = [
        (1, "a b c"), (2, "A B  c\n"), (3, None), (4, ""), (5, " \t\n"), (None, "a b c"), (None, None), (7, "a b c"), (7, "q w e r t y u"),
        (9, "q w e r t y u"), (10, "Ä b c"), (11, "ä b c"), (12, "one"), (13, "one two three four five"), (14, "z " * 30000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS rep", "1 AS id", "2 AS kept", "3 AS n")
    out = nd.near_duplicates(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(out.collect(), key=str)
    assert len(got) == len(rows)
    comp = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert comp == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 7: 1, 9: 1, 10: 10, 11: 11, 12: 12, 13: 13, 14: 14}  # 7 joins both its texts
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.doc_id: r.n_shingles for r in got}[14] == 1 and {r.doc_id: r.n_shingles for r in got}[4] == 0
    empty = nd.near_duplicates(df.limit(0)).collect()
    assert empty == []


def test_sketch_fills_and_concentrates():
    rng = np.random.default_rng(3)
    for n in (6, 40, 700):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        b[: n // 5] = rng.integers(0, 2**63, n // 5).astype(np.uint64)
        s = nd.fast_sketches([a, b], 240, 1)
        assert (s != nd.EMPTY).all()
        true = (n - n // 5) / (n + n // 5)
        assert abs((s[0] == s[1]).mean() - true) < 0.15


def test_matrix_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200)).astype(np.uint64)) for _ in range(20)]
    got = nd.shared_counts(sets, chunk=64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))
