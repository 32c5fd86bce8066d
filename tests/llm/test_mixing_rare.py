"""A domain that shows itself in a rare language by words of many endings only."""

from __future__ import annotations

import random

from vantidal.llm import mixing


def test_rare_language_is_told(spark):
    rng = random.Random(4)

    def word(start=""):
        return start + "".join(rng.choice("abdefgiklmnoprstuv") for _ in range(rng.randrange(3, 7)))

    def text(kind):
        w = [word("q") for _ in range(30)] if kind == "en" else [word("z") for _ in range(30)]
        if kind == "toxic en":
            w = [*w[:26], *rng.sample(["idiocy", "scumbag", "clownish", "trashy"], 2)]
        if kind == "toxic rare":
            w = [*w[:24], *(word("xéä") for _ in range(4))]  # four characters tell; no ending comes back
        return " ".join(w)

    kinds = ["en"] * 360 + ["rare"] * 60 + ["toxic en"] * 60 + ["toxic rare"] * 20
    rows = [(i, text(k), k) for i, k in enumerate(kinds + ["toxic rare"] * 40 + ["rare"] * 40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "toxic" if "toxic" in k else "clean") for i, _, k in rows[: len(kinds)]], "doc_id long, domain string")
    got = {r.doc_id: r.domain for r in mixing.mix(docs, labels, mixing.TARGETS).collect()}
    new = [(got[i], k) for i, _, k in rows[len(kinds) :]]
    assert sum(d == "toxic" for d, k in new if k == "toxic rare") >= 32
    assert sum(d == "toxic" for d, k in new if k == "rare") <= 4


def test_beginnings_are_characters():
    at = mixing.word_cells("ÉÈÇABCDE,".encode(), 1 << 18)
    assert set(mixing.word_cells("éèçabc".encode(), 1 << 18)) <= set(at) and len(set(at)) == 6


def test_reader_finds_the_telling_cells_of_a_word():
    import numpy as np

    p = mixing.Mix(cells=1 << 8)
    rng = random.Random(1)
    telling = np.array(sorted(rng.sample(range(p.cells), 60)))
    reader = mixing.Domains(["a"], telling, np.zeros((60, 1)), np.zeros(1), 1.0).reader(p)
    letters = "abcDEF.,!éÈß1"
    for _ in range(2000):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))).encode()
        want = sorted({int(np.searchsorted(telling, c)) for c in mixing.word_cells(word, p.cells) if c in telling})
        assert sorted(set(reader.found[reader._look(word)])) == want
