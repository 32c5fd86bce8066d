"""Learned operators on held-out rows, searches and rules against brute force, and odd rows in each."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from vantidal.llm import hamming, language_id, mixing, quality, registry, url_filters

TEN = "/root/testdata/sf0.01"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"))
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


ODD = [(1, "", "en"), (2, None, "en"), (None, "the and", "en"), (3, "123 !!!", None), (4, "the word " * 30_000, "en"), (5, "le mot et la", None), (5, "le mot et la", None), (6, "🙂 日本語", "ja")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "'s' AS score", "2 AS y", "3 AS held_out_x", "4 AS domain")


# --- Quality -----------------------------------------------------------------------------------


def test_quality_ranks_held_out_rows(spark):
    rows = registry.QUERIES["op2_quality"](spark, TEN).collect()
    docs = spark.read.parquet(f"{TEN}/documents.parquet")
    assert len(rows) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TEN}/labels.parquet").collect()}
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in test])
    assert auc(np.array([r.score for r in test]), y) > 0.97
    assert np.mean([r.predicted == labels[r.doc_id] for r in test]) > 0.93


def test_quality_of_odd_rows(spark):
    m = quality.Model(cells=1 << 10, epochs=2)
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (5, 1), (99, 0), (None, 1), (3, 7)], "doc_id long, quality int")
    table, net = quality.learn(odd(spark), labels, m)
    got = quality.score(odd(spark), table, net, m, keep=("doc_id", "score")).collect()
    assert len(got) == len(ODD) and all(0 <= r["__score"] <= 1 for r in got)
    by = {r.doc_id: r["__score"] for r in got}
    assert by[1] == by[2]
    nothing = quality.learn(odd(spark).limit(0), labels.limit(0), m)
    assert quality.score(odd(spark), *nothing, m).count() == len(ODD) and quality.score(odd(spark).limit(0), *nothing, m).count() == 0


def test_word_vectors_equal_brute_force(spark):
    m = quality.Model(cells=1 << 8, size=16, blocks=4)
    texts = ["a b c a B.", "b a", "", None, "x", "a b c d e f g"]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), m)
    places, signs = quality.index_vectors(m)
    want = np.zeros((m.cells, m.size))
    for t in texts:
        core, shape, _ = quality.unit_cells([(t or "").encode()], m.cells)
        for unit in (core, shape):
            for i, u in enumerate(unit):
                for j in range(max(0, i - m.window), min(len(unit), i + m.window + 1)):
                    if i != j:
                        for p, s in zip(places[unit[j]], signs[unit[j]], strict=True):
                            want[u, p] += s
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, want, atol=1e-6)


# --- Language ----------------------------------------------------------------------------------


def test_languages_of_held_out_rows(spark):
    rows = registry.QUERIES["op9_language_id"](spark, TEN).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{TEN}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_language_of_odd_rows(spark):
    p = language_id.Profiles(size=256)
    protos = language_id.learn_prototypes(odd(spark), p)
    assert sorted(protos) == ["en", "ja"]
    out = language_id.identify(odd(spark), protos, p).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] == "en" and by[6][0] == "ja"
    none = language_id.learn_prototypes(odd(spark).limit(0), p)
    assert none == {} and {r.lang_pred for r in language_id.identify(odd(spark), none, p).collect()} == {"und"}


def test_bundle_equals_binding_letter_by_letter():
    p = language_id.Profiles(size=128)
    sp = language_id.Space(p)
    codes, _ = language_id.trigrams("Aé 日".encode())
    letters = [ord(c) for c in "\0aé\0日\0"]
    vector = {x: sp.draw(np.array([x]))[0].astype(int) for x in letters}
    want = np.zeros(p.size)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        if b > 0:
            want += np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
    assert np.array_equal(sp.bundle(codes, np.ones(len(codes))), want)


def test_every_letter_has_a_vector_of_its_own(monkeypatch):
    sp = language_id.Space(language_id.Profiles())
    points = np.array([ord(c) for c in "абвгдежзийклмнопрстуфхцчшщъыьэюя日本語학교"])
    v = sp.draw(points).astype(int)
    off = np.abs(v @ v.T)[~np.eye(len(v), dtype=bool)]
    assert off.max() < 200  # of 1024: nearly orthogonal, none shared
    monkeypatch.setattr(language_id, "REMEMBERED", 8)  # forgetting changes nothing
    few = language_id.Space(language_id.Profiles())
    for text in ("привет мир", "日本語の本", "hello", "привет"):
        assert np.array_equal(few.profile(text.encode()), sp.profile(text.encode()))


def test_languages_of_one_script(spark):
    """Two languages in Cyrillic letters and one in Han ones, on rows that didn't teach."""
    import random

    rng = random.Random(3)
    words = {"ru": "и в не на что тот быть весь это как она они мы этот который год человек время рука дело жизнь день голова".split(),
             "uk": "і в не на що той бути весь це як вона вони ми цей який рік людина час рука справа життя день голова її є ї".split(),
             "zh": "的 一 是 不 了 人 我 在 有 他 这 中 大 来 上 国 个 到 说 们".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(25)), k) for i, k in enumerate(k for k in words for _ in range(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    protos = language_id.learn_prototypes(df.filter("doc_id % 2 = 0"), language_id.Profiles())
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df, protos).collect()}
    assert all(got[i] == k for i, _, k in rows if i % 2)


def test_language_query_equals_a_plain_loop(spark, sf):
    """op9 against profiles built one trigram after the other."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()[:60]
    p = language_id.Profiles()
    sp = language_id.Space(p)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    protos = language_id.learn_prototypes(df.filter("doc_id % 3 = 0"), p)
    for lang, v in protos.items():
        own = sum(sp.profile(d.text.encode()) for d in docs if d.doc_id % 3 == 0 and d.lang == lang)
        assert np.allclose(v, own / np.linalg.norm(own), atol=1e-5)
    got = {r.doc_id: r for r in language_id.identify(df, protos, p).collect()}
    for d in docs:
        x = np.zeros(p.size)
        codes, _ = language_id.trigrams(d.text.encode())
        for c in codes[:3000].tolist():
            a, b, e = (sp.draw(np.array([q]))[0].astype(int) for q in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF))
            x += np.roll(a, 2) * np.roll(b, 1) * e
        cosine = {k: v @ x / np.linalg.norm(x) for k, v in protos.items()}
        if len(codes) <= 3000:
            assert got[d.doc_id].lang_pred == max(cosine, key=cosine.get)


# --- Mixing ------------------------------------------------------------------------------------


def test_mixing_reaches_targets(spark):
    docs = spark.read.parquet(f"{TEN}/documents.parquet")
    labels = mixing.tones(spark.read.parquet(f"{TEN}/labels.parquet"))
    out = mixing.mix(docs, labels, {"clean": 1.0, "toxic": 0.5}).collect()
    assert len(out) == docs.count()
    w, r, post = (np.array([x[c] for x in out], float) for c in ("tokens", "rate", "post"))
    total = w.sum()
    now, then = (w @ post) / total, ((w * r) @ post) / total
    assert (r >= 0).all() and abs(then[0] - now[0]) < 2e-3 and abs(then[1] - 0.5 * now[0]) < 2e-3
    copies = np.array([x.copies for x in out])
    after = ((w * copies) @ post) / total
    assert abs(after[0] - now[0]) < 0.02 and abs(after[1] - 0.5 * now[0]) < 0.05  # the copies meet the targets, too
    assert (np.abs(copies - r) < 1).all() and {x.doc_id: x.tokens for x in out} == {d.doc_id: len(d.text.split()) for d in docs.collect()}


def test_rates_equal_least_squares():
    """Many steps on a small problem end where the normal equations do (no rate at its bound)."""
    rng = np.random.default_rng(1)
    post = rng.dirichlet((1, 1, 1), 50)
    w = rng.integers(1, 100, 50).astype(float)
    scale = w.sum()
    target = (w @ post) / scale * np.array([1.1, 0.9, 1.0])
    second = (post * w[:, None]).T @ post / scale
    history, gap = [], (w @ post) / scale - target
    for _ in range(500):
        history.append(gap / np.linalg.eigvalsh(second).max())
        gap = (w * mixing.rates_of(post, history)[1]) @ post / scale - target
    rates = mixing.rates_of(post, history)[0]
    exact = 1 + post @ np.linalg.solve(second, target - (w @ post) / scale)
    assert (exact > 0).all() and np.allclose(rates, exact, atol=1e-3)


def test_mixing_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, "a"), (4, "b"), (5, None), (99, "b"), (None, "a")], "doc_id long, domain string")
    out = mixing.mix(odd(spark), labels, {"a": 1.0, "b": 1.0, "none": 3.0}, keep=("score",)).collect()
    assert len(out) == len(ODD) and all(np.isfinite(r.rate) and r.rate >= 0 and r.copies >= 0 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1].tokens == by[2].tokens == 0 and by[1].rate == by[2].rate and by[4].tokens == 60_000
    assert mixing.mix(odd(spark).limit(0), labels, {"a": 1.0}).count() == 0
    assert {r.copies for r in mixing.mix(odd(spark), labels.limit(0), {"a": 1.0}).collect()} == {1}


# --- Search ------------------------------------------------------------------------------------


@pytest.mark.parametrize(("segments", "rows"), [(4, 65536), (8, 64)])
def test_search_equals_brute_force(spark, segments, rows):
    rng = np.random.default_rng(2)
    codes = rng.integers(-(2**63), 2**63, 600)
    codes[:200] = codes[0]  # a large group of equal codes
    codes[200:300] = codes[0] ^ (1 << rng.integers(0, 63, 100))
    table = [(i, int(c)) for i, c in enumerate(codes)]
    df = spark.createDataFrame([*table, table[0], table[7], (None, 5), (1000, None)], "id long, code long").repartition(5)
    got = {}
    for r in hamming.top_k(df, df.filter("id % 50 = 0"), hamming.Search(k=5, segments=segments, rows=rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.id))
    assert sorted(got) == list(range(0, 600, 50))
    for q, found in got.items():
        want = sorted((bin((int(codes[q]) ^ c) & (2**64 - 1)).count("1"), i) for i, c in table)[:5]
        assert [f[1:] for f in sorted(found)] == want
    assert hamming.top_k(df.limit(0), df).count() == 0 and hamming.top_k(df, df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, 0), (2, 3)], "id long, code long")
    assert sorted((r.query_id, r.rank, r.id) for r in hamming.top_k(few, few).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]


def test_sign_codes(spark):
    v = [1.0 if i % 3 else -1.0 for i in range(64)]
    df = spark.createDataFrame([(v,), (None,), ([],), ([0.0, 1.0, None, 2.0],)], "v array<double>")
    with pytest.raises(Exception, match="more than 64"):
        spark.createDataFrame([([1.0] * 65,)], "v array<double>").select(hamming.sign_code(hamming.F.col("v"))).collect()
    got = [r[0] for r in df.select(hamming.sign_code(hamming.F.col("v"))).collect()]
    want = sum(1 << i for i in range(64) if i % 3)
    assert got[0] & (2**64 - 1) == want and got[1:] == [None, 0, 0b1010]


# --- URL filters -------------------------------------------------------------------------------


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "https://b.org", "http://b.org/", "ftp://x.com/fr/a", "x.com/fr/a", None, "", "://", "http://COM/de/",
        "http://notcom/de/", "http://u@h.net:80/p/../q?x://y", "http://h.net#f", "http://é.com/fr/É?", "a\n://b.com/de/\nx",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").selectExpr("*", "'h' AS host", "1 AS n", "2 AS verdict")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filters.judge_pages(df).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("b.org", "", None), ("b.org", "/", "org/"),
        ("x.com", "/fr/a", "com/fr/"), ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("com", "/de/", "com/de/"), ("notcom", "/de/", None),
        ("u@h.net:80", "/p/../q", None), ("h.net", "", None), ("é.com", "/fr/É", "com/fr/"), ("b.com", "/de/\nx", "com/de/"),
    ]
    assert url_filters.judge_pages(df.limit(0)).count() == 0


def test_registered_domains(spark):
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "x.example.com": ("example.com", "com"), "u@h.net:80": ("h.net", "net"), "local": ("local", "local"),
            "www.gov.uk": ("www.gov.uk", "gov.uk"), "a.com.de": ("a.com.de", "com.de"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in want], "h string")
    F = url_filters.F
    assert {r[0]: (r[1], r[2]) for r in df.select("h", url_filters.registered_domain(F.col("h")), url_filters.suffix(F.col("h"))).collect()} == want


def test_reputation_shrinks(spark):
    rows = [("a.x.com", True)] * 40 + [("b.x.com", True)] + [("c.y.com", False)] * 40 + [("d.y.com", None)] + [("e.net", None), (None, None)]
    got = {r.host: r for r in url_filters.host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["a.x.com"].rate > got["b.x.com"].rate > 0.5 > got["d.y.com"].rate > 0 and got["e.net"].n == 0
    assert got["a.x.com"].bound < got["a.x.com"].rate and got[""].n == 0


def test_url_filters_equal_sql(spark):
    from tests.oracle import assert_same, duck

    assert_same(registry.QUERIES["op10_url_filters"](spark, TEN), duck(TEN), registry.SQL["op10_url_filters"])
    assert_same(registry.QUERIES["op6_hamming"](spark, TEN), duck(TEN), registry.SQL["op6_hamming"])


def test_url_filters_run_in_the_jvm(spark):
    plan = registry.QUERIES["op10_url_filters"](spark, TEN)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow") if w in plan]
