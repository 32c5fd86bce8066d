"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated.

A word is two units: its core (lower-cased letters and digits) and its shape (how case, digits and signs
follow one another, runs shortened). Each unit has a sparse random index vector; its word vector is the
sum of the index vectors of the units around it, over all documents. A document is the mean and the
spread of its units' vectors with a few repetition figures. A two-layer network scores it; its logit is
divided by a temperature fitted on rows that the network didn't see.

Units are hashed to a fixed number of cells, so the table's size is bounded whatever the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.llm.common import Words, batches, bounded, documents, give_back, is_held_out, mix, word_hash, word_values


@dataclass(frozen=True)
class Model:
    """Production parameters."""

    cells: int = 1 << 15  #: hashed units
    size: int = 64  #: of a word vector
    ones: int = 4  #: non-zeros of an index vector
    window: int = 2  #: words on either side
    sample: int = 20_000  #: labelled rows that the network is fitted on, at most (those of the least hash)
    hidden: int = 32
    epochs: int = 60
    seed: int = 7
    threshold: float = 0.7
    blocks: int = 64  #: parts in which the table is added up


# --- Units -------------------------------------------------------------------------------------

_NOT_CORE = re.compile(rb"[^a-z0-9\x80-\xff]+")
_RUNS = re.compile(rb"(.)\1+", re.S)
_CLASSES = bytes(
    ord("A") if 65 <= i <= 90 else ord("a") if 97 <= i <= 122 else ord("0") if 48 <= i <= 57 else ord("u") if i >= 128 else i
    for i in range(256)
)


def unit_pair(word: bytes) -> int:
    """The hashes of a word's core and shape (32 bits each) in one number."""
    core = _NOT_CORE.sub(b"", word.lower())
    shape = _RUNS.sub(rb"\1+", word.translate(_CLASSES))[:24]
    return (word_hash(b"c" + core) & 0xFFFFFFFF) << 32 | (word_hash(b"s" + shape) & 0xFFFFFFFF)


_units = Words(unit_pair)


def unit_cells(texts: list[bytes | None], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Core cells and shape cells of all words, and the number of words of each text."""
    h, counts = word_values(texts, _units)
    core = ((h >> np.uint64(32)) % np.uint64(cells // 2)).astype(np.int64)
    shape = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(cells // 2)).astype(np.int64) + cells // 2
    return core, shape, counts


def index_vectors(m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zeros of each cell's index vector."""
    draws = mix((np.uint64(m.seed) << np.uint64(40)) + np.arange(m.cells * m.ones, dtype=np.uint64)).reshape(m.cells, m.ones)
    return (draws % np.uint64(m.size)).astype(np.int64), np.where(draws >> np.uint64(63), 1, -1).astype(np.int64)


def _count_contexts(table: np.ndarray, texts: list[bytes | None], m: Model, places: np.ndarray, signs: np.ndarray) -> None:
    core, shape, counts = unit_cells(texts, m.cells)
    doc = np.repeat(np.arange(len(counts)), counts)
    flat = table.reshape(-1)
    for step in range(1, m.window + 1):
        near = np.flatnonzero(doc[:-step] == doc[step:]) if len(doc) > step else np.empty(0, np.int64)
        for a, b in ((near, near + step), (near + step, near)):
            for unit in (core, shape):
                # Cores are described by the cores around them, shapes by the shapes.
                at, of = unit[a] * m.size, unit[b]
                for k in range(m.ones):
                    np.add.at(flat, at + places[of, k], signs[of, k])


def word_vectors(docs: DataFrame, m: Model, text_col: str = "text") -> np.ndarray:
    """The table of unit vectors (cells x size, unit length), from all documents.

    Each task adds up a table of its own and sends its non-empty blocks compressed; blocks are added in a
    stream, so no task holds more than one table. Counts are whole numbers: any order gives the same sums.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(m)
        table = np.zeros((m.cells, m.size), np.int64)
        seen = False
        for _, texts in batches(rows):
            _count_contexts(table, texts, m, places, signs)
            seen = True
        if seen:
            z = zstandard.ZstdCompressor(level=1)
            step = m.cells // m.blocks
            parts = [(b, table[b * step : (b + 1) * step]) for b in range(m.blocks)]
            parts = [(b, z.compress(t.tobytes())) for b, t in parts if t.any()]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in parts], pa.int32()), pa.array([t for _, t in parts], pa.binary())], ["block", "part"]
                )

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        d = zstandard.ZstdDecompressor()
        for batch in rows:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True):
                t = np.frombuffer(d.decompress(raw), np.int64)
                sums[b] = sums[b] + t if b in sums else t
        for b, t in sums.items():
            # In full the sums may be large; half precision of the scaled rows is what the model uses.
            rows_ = t.reshape(-1, m.size).astype(np.float64)
            rows_ /= np.maximum(np.linalg.norm(rows_, axis=1, keepdims=True), 1e-9)
            out = rows_.astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([out], pa.binary())], ["block", "part"])

    schema = "block int, part binary"
    parts = bounded(docs.select(F.col(text_col).cast("string").alias("text"))).mapInArrow(count, schema)
    sums = parts.repartition(m.blocks, "block").mapInArrow(add, schema)
    out = np.zeros((m.cells, m.size), np.float32)
    step = m.cells // m.blocks
    for r in sums.collect():  # the whole table has cells * size numbers: 8 MB
        out[r.block * step : (r.block + 1) * step] = np.frombuffer(r.part, np.float32).reshape(step, m.size)
    return out


# --- Documents ---------------------------------------------------------------------------------


def features(m: Model) -> int:
    return 4 * m.size + 5


def pooled(texts: list[bytes | None], table: np.ndarray, m: Model) -> np.ndarray:
    """A row for each text: mean and spread of its cores' and shapes' vectors, repetition and length."""
    core, shape, counts = unit_cells(texts, m.cells)
    out = np.zeros((len(texts), features(m)), np.float32)
    at = 0
    s = m.size
    for i, n in enumerate(counts.tolist()):
        if n:
            c, h = core[at : at + n], shape[at : at + n]
            for j, u in enumerate((c, h)):
                cells, k = np.unique(u, return_counts=True)
                w = (k / n).astype(np.float32)
                v = table[cells]
                mean = w @ v
                out[i, 2 * j * s : (2 * j + 1) * s] = mean
                out[i, (2 * j + 1) * s : (2 * j + 2) * s] = np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))
                out[i, 4 * s + j] = len(cells) / n
            same = (c[1:] == c[:-1]).mean() if n > 1 else 0.0
            pairs = len(np.unique(c[1:] * m.cells + c[:-1])) / (n - 1) if n > 1 else 1.0
            out[i, 4 * s + 2 :] = (same, pairs, np.log1p(n) / 10)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    prior: float = 0.0  #: log-odds of the labels: what a text without words gets
    trust: float = 30.0  #: of n words the network's logit counts n*n / (n*n + trust), the prior the rest

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        n = np.expm1(10 * x[:, -1])  # the last feature holds the length
        w = n * n / (n * n + self.trust)
        return _sigmoid(w * self.logits(x) / self.temperature + (1 - w) * self.prior)


def _chunks(rows: np.ndarray) -> Iterator[np.ndarray]:
    return (rows[s : s + 1024] for s in range(0, len(rows), 1024))


def fit(x: np.ndarray, y: np.ndarray, m: Model) -> Network:
    """Adam on the log loss with weight decay; every fifth row is kept back for the temperature.

    With one class or none the network answers that class's share (a half without rows).
    """
    d = x.shape[1] if x.ndim == 2 else features(m)
    rng = np.random.default_rng(m.seed)
    if len(y) < 10 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        zero = np.zeros((d, m.hidden))
        odds = float(np.log(share / (1 - share)))
        return Network(np.zeros(d), np.ones(d), zero, np.zeros(m.hidden), np.zeros(m.hidden), odds, prior=odds)
    order = rng.permutation(len(y))
    back, fitted = order[: len(y) // 5], order[len(y) // 5 :]
    mean = sum(x[i].sum(0, dtype=np.float64) for i in _chunks(fitted)) / len(fitted)
    scale = np.sqrt(sum(((x[i] - mean) ** 2).sum(0) for i in _chunks(fitted)) / len(fitted)) + 1e-6
    net = Network(
        mean, scale, rng.normal(0, np.sqrt(2 / d), (d, m.hidden)), np.zeros(m.hidden),
        rng.normal(0, np.sqrt(1 / m.hidden), m.hidden), float(np.log(y[fitted].mean() / (1 - y[fitted].mean() + 1e-9) + 1e-9)),
    )
    net.prior = net.b2
    parts = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step, size = 0, 256
    for epoch in range(m.epochs):
        rate = 2e-3 * 0.5 * (1 + np.cos(np.pi * epoch / m.epochs))
        fitted = rng.permutation(fitted)
        for s in range(0, len(fitted), size):
            i = fitted[s : s + size]
            z = (x[i] - mean) / scale  # in doubles, a minibatch at a time
            pre = z @ parts[0] + parts[1]
            h = np.maximum(pre, 0)
            g = (_sigmoid(h @ parts[2] + parts[3][0]) - y[i]) / len(i)
            gh = np.outer(g, parts[2]) * (pre > 0)
            grads = [z.T @ gh + 1e-4 * parts[0], gh.sum(0), h.T @ g + 1e-4 * parts[2], np.array([g.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                parts[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = parts[0], parts[1], parts[2], float(parts[3][0])
    if len(back):
        raw = net.logits(x[back])
        grid = np.exp(np.linspace(0, np.log(16), 61))

        def loss(t: float) -> float:
            p = np.clip(_sigmoid(raw / t), 1e-9, 1 - 1e-9)
            return -float(np.mean(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p)))

        net.temperature = float(min(grid, key=loss))
    return net


def _pool(docs: DataFrame, table, m: Model) -> DataFrame:
    """id, y, x (features as bytes) of labelled rows."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(rows):
            x = pooled(texts, table.value, m)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"]
            )

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"id {kind}, y int, x binary")


def learn(
    docs: DataFrame, labels: DataFrame, m: Model | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", vectors_from: DataFrame | None = None,
) -> tuple[np.ndarray, Network]:
    """The unit vectors (from all documents) and the network, fitted on labelled rows whose id isn't held out.

    Of the labelled rows those with the least hash of the id are taken, `m.sample` at most; that bound makes
    the list of ids and the collected features bounded too. Null labels, labels other than 0 and 1 and
    labels of unknown documents teach nothing; of contradicting labels of one id the larger counts.
    """
    m = m or Model()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    table = word_vectors(vectors_from if vectors_from is not None else docs, m, text_col)
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1)")
    y = y.filter(~is_held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    y = y.orderBy(F.xxhash64("id"), "id").limit(m.sample)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    rows = _pool(picked.join(F.broadcast(y), "id").select("id", "y", "text"), sent, m).toArrow()  # m.sample rows, in single precision
    sent.destroy()
    ids, ys, xs = (rows.column(c).to_pylist() for c in ("id", "y", "x"))
    del rows
    order = sorted(range(len(ids)), key=lambda i: (ids[i], xs[i]))  # the fit mustn't depend on the order of the tasks
    x = np.frombuffer(b"".join([xs[i] for i in order]), np.float32).reshape(len(order), features(m))
    net = fit(x, np.array([ys[i] for i in order], np.float64), m)
    del x, xs
    give_back()
    return table, net


def score(
    docs: DataFrame, table: np.ndarray, net: Network, m: Model | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The kept columns with score (0 to 1) for every row, from the text alone; a null text counts as empty."""
    m = m or Model()
    sent = docs.sparkSession.sparkContext.broadcast((table, net))  # bounded by the model's parameters

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, net_ = sent.value
        for batch, texts in batches(rows, "__text"):
            s = np.round(net_.scores(pooled(texts, table_, m)), 9)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64())], [*batch.schema.names[:-1], "__score"])

    kinds = dict(docs.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    picked = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    return picked.mapInArrow(run, f"{head}, __score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model()
    docs = documents(spark, sf_dir)
    table, net = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), m)
    out = score(docs, table, net, m).withColumnRenamed("__score", "score")
    return out.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= m.threshold).cast("int").alias("predicted")
    )
