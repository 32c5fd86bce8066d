"""Mixing sources to target weights by soft membership.

A classifier that learned domains from a labelled table gives each document the posterior of every
domain. A document with rate r then adds r times its tokens times its posteriors to the domains' expected
totals. Rates are the nonnegative least-squares fit of those totals to the targets, starting from 1:
accelerated projected gradient steps, in which the gradient of every document is its posteriors times the
domains' residuals. A document's rate follows from its posteriors and the short list of residuals, so no state is kept for
it, and documents with the same (rounded) posteriors have the same rate: their tokens are added up once, and an iteration is
a pass over these sums that adds up a number for each domain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as xxh3

from vantidal.llm.common import Words, batches, bounded, documents, give_back, runs
from vantidal.session import forget, through_store


@dataclass(frozen=True)
class Mix:
    """Production parameters."""

    cells: int = 1 << 18  #: hashed words
    sample: int = 10_000  #: labelled rows that the classifier is fitted on, at most (those of the least hash)
    telling: int = 1024  #: cells that count, at most: those whose shares in and outside a domain differ by most deviations
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7, 8)  #: characters of a word's beginnings
    decay: float = 1e-4
    seed: int = 11
    steps: int = 60
    close: float = 1e-4  #: the fit ends when each domain is within this share of all tokens
    grain: int = 1000  #: posteriors are rounded to whole parts of it


# --- Domains -----------------------------------------------------------------------------------

_SIGNS = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def word_cells(word: bytes, cells: int, beginnings: tuple[int, ...] = Mix.beginnings) -> tuple[int, ...]:
    """The cells of a word without signs, in lower case: of the whole and of its beginnings (in characters)."""
    w = word.strip(_SIGNS)
    if w.isascii():  # characters are bytes
        w = w.lower()
        size = len(w)
        if not size:
            return ()
        return (xxh3(w[:64]) % cells, *[xxh3(w[:n]) % cells for n in beginnings if n < size])
    w = w.decode("utf-8", "replace").lower()
    size = len(w)
    return (xxh3(w[:64].encode()) % cells, *[xxh3(w[:n].encode()) % cells for n in beginnings if n < size])


@dataclass
class Domains:
    """Logistic regression over telling cells: whether a text has a word (or a beginning) of that cell."""

    names: list[str]
    telling: np.ndarray  #: cells that count
    weights: np.ndarray  #: telling cells x domains
    bias: np.ndarray
    temperature: float

    def reader(self, p: Mix) -> Reader:
        return Reader(self, p)


class Reader:
    """Posteriors of texts. A word's telling cells are looked up once a worker; most words have none."""

    def __init__(self, domains: Domains, p: Mix):
        self.domains, self.p = domains, p
        self.at = {int(c): i for i, c in enumerate(domains.telling)}
        self.found: list[tuple[int, ...]] = [()]
        self.words = Words(self._look)

    def _look(self, word: bytes) -> int:
        """The number of the word's telling cells in `found`; 0 without any. What `word_cells` says, without the cells that don't tell."""
        at, cells = self.at, self.p.cells
        w = word.strip(_SIGNS).lower()
        if w.isascii():
            hit = [at[c] for c in [xxh3(w[:64]) % cells] if c in at] if w else []
            size = len(w)
            for n in self.p.beginnings:
                if n < size and (c := xxh3(w[:n]) % cells) in at:
                    hit.append(at[c])
        else:
            hit = [at[c] for c in word_cells(word, cells, self.p.beginnings) if c in at]
        if not hit:
            return 0
        hit = tuple(hit)
        self.found.append(hit)
        return len(self.found) - 1

    def posteriors(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        d = self.domains
        logits = np.zeros((len(texts), len(d.names)))
        counts = np.zeros(len(texts), np.int64)
        if len(self.found) > 1_000_000:
            self.words.clear()
            del self.found[1:]
        for i, t in enumerate(texts):
            hits: set[int] = set()
            for run in runs(t) if t else ():
                w = run.split()
                counts[i] += len(w)
                hits.update(map(self.words.__getitem__, w))
            cells = sorted({c for h in hits for c in self.found[h]})
            if cells:
                logits[i] = d.weights[cells].sum(axis=0)
        logits = (logits + d.bias) / d.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), counts


def fit_domains(cells_of: list[np.ndarray], y: np.ndarray, names: list[str], p: Mix) -> Domains:
    """Weights of the best cells from four fifths of the rows; the rest gives the temperature and says how many cells count.

    No cell must pass a bar: small and rare domains and languages have none that would. Of p.telling cells, half as
    many and so on, the number counts whose loss on the held-back rows is least.
    """
    k = len(names)
    order = np.random.default_rng(p.seed).permutation(len(y))
    back, fitted = order[: len(y) // 5], order[len(y) // 5 :]
    if k == 1 or len(fitted) < 10:
        n = np.bincount(y, minlength=k) + 1.0
        return Domains(names, np.empty(0, np.int64), np.zeros((0, k)), np.log(n / n.sum()), 1.0)
    n = np.maximum(np.bincount(y[fitted], minlength=k), 1).astype(np.float64)
    have = np.zeros((k, p.cells))
    for i in fitted:
        have[y[i], cells_of[i]] += 1
    total = n.sum()
    share, rest = have / n[:, None], (have.sum(0) - have) / np.maximum(total - n, 1)[:, None]
    base = (have.sum(0) + 1) / (total + 2)
    z = np.abs(share - rest) / np.sqrt(base * (1 - base) * (1 / n + 1 / np.maximum(total - n, 1))[:, None])
    ranked = np.argsort(-z.max(axis=0), kind="stable")[: p.telling]
    column = np.full(p.cells, -1)
    column[ranked] = np.arange(len(ranked))

    def matrix(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), len(ranked)), np.float32)
        for j, i in enumerate(rows):
            at = column[cells_of[i]]
            x[j, at[at >= 0]] = 1
        return x

    def ones(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.ones((len(x), 1), np.float32)])

    x_all, x_back, target = matrix(fitted), matrix(back), np.eye(k, dtype=np.float32)[y[fitted]]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))

    def fit(count: int) -> tuple[float, Domains]:
        x = ones(x_all[:, :count])
        w = np.zeros((x.shape[1], k))
        v = np.zeros_like(w)
        step = 4.0 / max(1.0, float(x.sum(axis=1).max()))
        for i in range(400):  # accelerated gradient on the log loss with weight decay
            at = w + i / (i + 3) * (w - v)
            e = x @ at.astype(np.float32)
            e = np.exp(e - e.max(axis=1, keepdims=True))
            grad = (x.T @ (e / e.sum(axis=1, keepdims=True) - target)).astype(np.float64) / len(x)
            grad[:-1] += p.decay * at[:-1]
            v, w = w, at - step * grad
        places = np.argsort(ranked[:count], kind="stable")
        out = Domains(names, ranked[:count][places], w[:-1][places], w[-1], 1.0)
        if len(back) < 10:
            return 0.0, out
        raw = ones(x_back[:, :count]).astype(np.float64) @ w

        def loss(t: float) -> float:
            q = raw / t
            q = q - q.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(back)), y[back]]))

        out.temperature = float(min(grid, key=loss))
        return loss(out.temperature), out

    # The larger of equals; without held-back rows all cells count.
    counts = [c for c in (p.telling >> s for s in range(5)) if c] if len(back) >= 10 else [p.telling]
    return min((fit(c) for c in counts), key=lambda f: f[0])[1]


def learn_domains(docs: DataFrame, labelled: DataFrame, p: Mix, id_col: str = "doc_id", text_col: str = "text") -> Domains:
    """`labelled` has the id and `domain` (string). At most `p.sample` labelled rows teach, so the ids that are sent
    and the rows that come back are bounded. Null domains teach nothing; of several domains of an id the last counts."""
    y = labelled.select(F.col(id_col).alias("id"), F.col("domain").cast("string")).filter("id IS NOT NULL AND domain IS NOT NULL")
    y = y.groupBy("id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(p.sample)
    picked = bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(rows):
            cells = []
            for t in texts:
                own = {c for run in runs(t or b"") for w in set(run.split()) for c in word_cells(w, p.cells, p.beginnings)}
                cells.append(np.array(sorted(own), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("domain"), pa.array(cells, pa.binary())], ["id", "domain", "cells"]
            )

    kind = dict(docs.dtypes)[id_col]
    sample = picked.join(F.broadcast(y), "id").select("id", "domain", "text").mapInArrow(run, f"id {kind}, domain string, cells binary")
    table = sample.toArrow()  # p.sample rows at most
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "domain", "cells")), strict=True))
    del table
    names = sorted({d for _, d, _ in rows}) or ["all"]
    at = {d: i for i, d in enumerate(names)}
    out = fit_domains([np.frombuffer(c, np.int32) for _, _, c in rows], np.array([at[d] for _, d, _ in rows], np.int64), names, p)
    give_back()
    return out


# --- Rates -------------------------------------------------------------------------------------


def rates_of(post: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's rate after the given moves, and the point where the next gradient is taken (Nesterov's).

    A move holds a number for each domain: its residual times the step.
    """
    rate = point = np.ones(len(post))
    t = 1.0
    for move in history:
        new = np.maximum(0.0, point - post @ move)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        point, rate, t = new + (t - 1) / t2 * (new - rate), new, t2
    return rate, point


def _post(batch: pa.RecordBatch, k: int, grain: int) -> np.ndarray:
    raw = b"".join(batch.column("post").to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(batch.num_rows, k) / grain


def fit_rates(members: DataFrame, targets: np.ndarray, p: Mix) -> tuple[list[np.ndarray], dict]:
    """The moves whose steps give the rates, from rows (tokens, post): one for each posterior, with its tokens' sum.
    Targets are shares of all tokens.

    Tokens weigh the squared change of a document's rate, so rates depend on posteriors alone and long
    documents aren't preferred. The step is the inverse of the largest eigenvalue of the domains' token-weighted
    second moments, found by the first pass.
    """
    k = len(targets)

    def passes(history: list[np.ndarray], moments: bool) -> tuple[np.ndarray, np.ndarray, float]:
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, second, tokens = np.zeros(k), np.zeros((k, k)), 0
            for batch in rows:
                post, w = _post(batch, k, p.grain), batch.column("tokens").to_numpy().astype(np.float64)
                total += (w * rates_of(post, history)[1]) @ post
                if moments:
                    second += (post * w[:, None]).T @ post
                tokens += float(w.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k * k + k + 1)), pa.array(np.concatenate([total, second.ravel(), [tokens]]))], ["cell", "x"]
            )

        sums = members.select("tokens", "post").mapInArrow(run, "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x"))
        out = np.zeros(k * k + k + 1)
        for r in sums.collect():  # a few numbers
            out[r.cell] = r.x
        return out[:k], out[k:-1].reshape(k, k), out[-1]

    total, second, tokens = passes([], True)
    scale = max(tokens, 1.0)
    largest = float(np.linalg.eigvalsh(second / scale).max()) if tokens else 1.0
    history: list[np.ndarray] = []
    gap = total / scale - targets
    for _ in range(p.steps):
        if np.abs(gap).max() <= p.close:
            break
        # Residuals are rounded, so that sums in another order give the same rates.
        history.append(np.round(gap / max(largest, 1e-9), 12))
        total, _, _ = passes(history, False)
        before, gap = gap, total / scale - targets
        if np.abs(gap - before).max() <= p.close / 10:  # no rates come closer
            break
    return history, {"tokens": tokens, "steps": len(history), "gap": float(np.abs(gap).max())}


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], p: Mix | None = None, id_col: str = "doc_id",
        text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the kept columns, tokens, domain (the likeliest), post (array), rate and copies for every row.

    `weights` are the targets of the domains relative to one another; domains that it doesn't name keep their
    expected tokens. The whole is scaled so that the domain with the largest weight keeps its tokens. Tokens are
    words of the whole text; null and empty texts have none, add nothing to any total, and get the rate
    that their posteriors (the domains' shares) give. `copies` is the rate rounded by the hash of id and text: the rate's
    whole part, and one more with the fraction's probability, so copies have the rate as their expectation. Rows that
    repeat an id and null ids get what their own text says; equal rows get equal copies.
    """
    p = p or Mix()
    domains = learn_domains(docs, labelled, p, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(domains)  # domains x cells numbers
    k = len(domains.names)
    names = [id_col, *keep]
    kinds = dict(docs.dtypes)
    head = ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(names))
    picked = bounded(docs.select(
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(names)),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"), F.col(text_col).cast("string").alias("text"),
    ))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = sent.value.reader(p)
        for batch, texts in batches(rows):
            post, counts = reader.posteriors(texts)
            packed = pa.array([r.tobytes() for r in np.round(post * p.grain).astype(np.uint16)], pa.binary())
            cols = [batch.column(i) for i in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts), packed], [*batch.schema.names[:-1], "tokens", "post"])

    members = through_store(picked.mapInArrow(run, f"{head}, draw bigint, tokens bigint, post binary"), "mixed")
    groups = through_store(members.groupBy("post").agg(F.sum("tokens").alias("tokens")), "posteriors")

    # Targets: shares of all tokens, in the scale in which the heaviest named domain keeps its own.
    def totals(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k)
        for batch in rows:
            out += batch.column("tokens").to_numpy().astype(np.float64) @ _post(batch, k, p.grain)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(out)], ["cell", "x"])

    now = np.zeros(k)
    for r in groups.mapInArrow(totals, "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        now[r.cell] = r.x
    now /= max(now.sum(), 1.0)
    targets = now.copy()
    named = [i for i, d in enumerate(domains.names) if d in weights]
    if named:
        top = max(named, key=lambda i: weights[domains.names[i]])
        unit = now[top] / max(weights[domains.names[top]], 1e-12)
        for i in named:
            targets[i] = weights[domains.names[i]] * unit
    history, _ = fit_rates(groups, targets, p)
    forget(groups)
    labels = domains.names

    def rate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            post = _post(batch, k, p.grain)
            r = np.round(rates_of(post, history)[0], 6)
            u = (batch.column("draw").to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64) / 2**53
            copies = np.floor(r + u).astype(np.int64)
            cols = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*cols, batch.column("tokens"), pa.array([labels[i] for i in post.argmax(axis=1)], pa.string()),
                 pa.array(post.tolist(), pa.list_(pa.float64())), pa.array(r), pa.array(copies)],
                [*batch.schema.names[: len(names)], "tokens", "domain", "post", "rate", "copies"],
            )

    out = members.mapInArrow(rate, f"{head}, tokens bigint, domain string, post array<double>, rate double, copies bigint")
    out = out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "tokens", "domain", "post", "rate", "copies")
    out._reads = (members,)
    return out


#: The pipeline's domains: what the labelled table says of a document's tone. The corpus shall keep its clean text and hold
#: a five-hundredth of that in toxic text.
TARGETS = {"clean": 1.0, "toxic": 0.002}
#: The registered query's domains: the languages of clean documents, and toxic ones of any language.
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1, "toxic": 0.01}


def tones(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("toxic") == 0, F.lit("clean"))
    return labels.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL")


def languages(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Of labelled documents the language, or `toxic`; without both none."""
    known = labels.select("doc_id", "toxic").join(docs.select("doc_id", "lang"), "doc_id")
    domain = F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("toxic") == 0, F.col("lang"))
    return known.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    out = mix(docs, languages(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs), LANGUAGES)
    return out.select("doc_id", "tokens", "domain", "post", "rate", "copies")
