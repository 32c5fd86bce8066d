"""Language ID with hyperdimensional profiles.

Every letter of every script has a random vector of +1 and -1 of its own, drawn from its code point. A trigram's vector binds
its letters: the first shifted twice, the second once, the third as it is, multiplied. A document's profile bundles (adds up)
its trigrams' vectors; a language's prototype adds up the unit profiles of its training documents. Profiles
are compared with prototypes by cosine.

Bundling is linear, so a profile is the trigram counts times the matrix of trigram vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.llm.common import batches, bounded, documents, is_held_out, mix, runs

#: Letters whose vectors a worker remembers (1 kB each); beyond this it starts anew.
REMEMBERED = 1 << 14


@dataclass(frozen=True)
class Profiles:
    """Production parameters."""

    size: int = 1024
    seed: int = 20240521
    sharpness: float = 24.0  #: cosines are multiplied by this for the softmax that gives the score


_letters: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _letters:  # of the basic plane, once a worker
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000))
    out = _letters[0][np.minimum(points, 0xFFFF)]
    beyond = points > 0xFFFF
    if beyond.any():
        seen, at = np.unique(points[beyond], return_inverse=True)
        out[beyond] = np.fromiter((chr(c).isalpha() for c in seen.tolist()), bool, len(seen))[at]
    return out


#: Bits of a code point within a trigram's code; a blank is 0.
POINT = 21


def trigrams(text: bytes) -> tuple[np.ndarray, bool]:
    """The trigram codes of a text's words in lower case, each word between blanks, and whether it has a letter."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    letters = is_letter(points)
    if not letters.any():
        return np.empty(0, np.int64), False
    # One blank between words: of what isn't a letter keep the first of each run.
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    k = np.concatenate([[0], np.where(letters, points, 0)[keep], [0]]).astype(np.int64)
    codes = k[:-2] << 2 * POINT | k[1:-1] << POINT | k[2:]
    return codes[k[1:-1] > 0], True  # the middle one is a letter


class Space:
    """Letter and trigram vectors of one seed."""

    def __init__(self, p: Profiles):
        self.size, self.seed = p.size, p.seed
        self.known = np.empty(0, np.int64)  # code points in order
        self.third = self.second = self.first = np.empty((0, p.size), np.int8)  # their vectors, as they are and shifted

    def draw(self, points: np.ndarray) -> np.ndarray:
        """The vectors of code points: a row each, from the point and the seed alone."""
        cells = points.astype(np.uint64)[:, None] * np.uint64(self.size) + np.arange(self.size, dtype=np.uint64)
        draws = mix((np.uint64(self.seed) << np.uint64(32)) + cells)
        return np.where(draws >> np.uint64(63), 1, -1).astype(np.int8)

    def places(self, points: np.ndarray) -> np.ndarray:
        """The rows of the code points in the tables; new ones are drawn."""
        new = np.setdiff1d(points, self.known)
        if len(new):
            known, rows = (self.known, self.third) if len(self.known) + len(new) <= REMEMBERED else (self.known[:0], self.third[:0])
            if not len(known):
                new = np.unique(points)
            order = np.argsort(both := np.concatenate([known, new]), kind="stable")
            self.known, self.third = both[order], np.concatenate([rows, self.draw(new)])[order]
            self.second, self.first = np.roll(self.third, 1, axis=1), np.roll(self.third, 2, axis=1)
        return np.searchsorted(self.known, points)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors times their counts."""
        out = np.zeros(self.size, np.float64)
        low = (1 << POINT) - 1
        for s in range(0, len(codes), 4096):
            c = codes[s : s + 4096]
            at = self.places(np.concatenate([c >> 2 * POINT, c >> POINT & low, c & low])).reshape(3, -1)
            bound = self.first[at[0]] * self.second[at[1]] * self.third[at[2]]
            out += counts[s : s + 4096].astype(np.float32) @ bound.astype(np.float32)
        return out

    def profile(self, text: bytes | None) -> np.ndarray | None:
        """The unit profile; None without a letter. A very long text is read in runs, whose profiles add up."""
        total = None
        for run in runs(text) if text else ():
            codes, any_letter = trigrams(run)
            if any_letter:
                seen, counts = np.unique(codes, return_counts=True)
                v = self.bundle(seen, counts)
                total = v if total is None else total + v
        return None if total is None else total / (np.linalg.norm(total) or 1.0)


_spaces: dict[Profiles, Space] = {}


def space(p: Profiles) -> Space:
    if p not in _spaces:
        _spaces.clear()
        _spaces[p] = Space(p)
    return _spaces[p]


def learn_prototypes(docs: DataFrame, p: Profiles, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A unit prototype for each language of the rows: the sum of all their unit profiles.

    Each task adds up its own rows; what reaches the driver is a vector for each task and language, summed
    in bounded steps, never a vector for each document. Rows without language or letters teach nothing.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        sp = space(p)
        for batch, texts in batches(rows):
            for lang, t in zip(batch.column("lang").to_pylist(), texts, strict=True):
                v = sp.profile(t)
                if v is not None:
                    if lang not in sums:
                        sums[lang] = np.zeros(p.size)
                    sums[lang] += v
        if sums:
            # Fixed point, so that the total doesn't depend on the order of the tasks.
            cells = [np.round(v * 2**20).astype(np.int64) for v in sums.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array(cells, pa.list_(pa.int64()))], ["lang", "v"]
            )

    rows = bounded(docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")))
    parts = rows.filter("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "lang string, v array<bigint>")
    total = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    packed = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v"))
    out = {}
    for r in sorted(packed.collect(), key=lambda r: r.lang):
        v = np.array([x.x for x in r.v], np.float64)
        out[r.lang] = v / (np.linalg.norm(v) or 1.0)
    return out


def identify(
    docs: DataFrame, prototypes: dict[str, np.ndarray], p: Profiles | None = None, id_col: str = "doc_id", text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """id, the kept columns, lang_pred and score for every row.

    A null text and one without a letter are `und` with score 0, as is everything where there are no
    prototypes. The score is the softmax of the cosines, between 0 and 1. Equal cosines go to the first
    language in alphabetical order.
    """
    p = p or Profiles()
    langs = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in langs]) if langs else np.zeros((0, p.size))
    sent = docs.sparkSession.sparkContext.broadcast(matrix)  # languages x size numbers

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = space(p)
        for batch, texts in batches(rows):
            pred, score = [], []
            for t in texts:
                v = sp.profile(t) if langs else None
                if v is None:
                    pred.append("und")
                    score.append(0.0)
                    continue
                cosine = sent.value @ v
                best = int(np.argmax(cosine))
                e = np.exp(p.sharpness * (cosine - cosine[best]))
                pred.append(langs[best])
                score.append(round(float(e[best] / e.sum()), 9))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"]
            )

    kinds = dict(docs.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep))
    picked = bounded(docs.select(id_col, *keep, F.col(text_col).cast("string").alias("text")))
    return picked.mapInArrow(run, f"{head}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Profiles()
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", is_held_out(F.col("doc_id")))
    prototypes = learn_prototypes(docs.filter(~F.col("held_out")), p)
    return identify(docs, prototypes, p, keep=("held_out",))
