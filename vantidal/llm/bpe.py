"""BPE encoding and decoding through a pair occurrence index.

A partition's texts are cut into pieces; the distinct pieces that haven't been met yet are laid out in
one linked array of symbols, with an index from each adjacent pair to all its positions. Active ranks
are taken in ascending order from a heap: all positions of the lowest pair are merged, and the lists of
the pairs beside them are updated. A merge yields a token whose own merges come later, so one ascending
sweep over all pieces gives what merging piece by piece would.

The vocabulary is a tokenizer file of byte-level BPE (`model.vocab`, `model.merges`, `added_tokens`).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.llm.common import batches, bounded, documents

#: The cut of byte-level BPE (letters, numbers and the rest, each with a leading blank).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: The same cut over Latin-1 bytes, for texts without other characters. Alternatives begin with different
#: characters, so letters may be tried first.
LETTERS = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
BLANKS = rb"\t\n\x0b\x0c\r \x85\xa0"
LATIN_PIECES = (
    rb" ?[%(l)b]+|'s|'t|'re|'ve|'m|'ll|'d| ?[%(n)b]+| ?[^%(s)b%(l)b%(n)b]+|[%(s)b]+(?![^%(s)b])|[%(s)b]+"
    % {b"l": LETTERS, b"n": NUMBERS, b"s": BLANKS}
)

#: Distinct pieces that a worker remembers; beyond this it starts anew.
KNOWN_PIECES = 100_000


#: Characters of a text that are cut into pieces at once.
LONG = 1 << 20
_ENDS = re.compile(r"(?<=[^\s\x85\u180e])[ \n]")


def parts(text: str) -> Iterator[str]:
    """A text in parts that end before a blank after something else: no piece and no special token crosses that."""
    at = 0
    while len(text) - at > LONG:
        m = _ENDS.search(text, at + LONG)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable ones stand for themselves."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndex:
    """Merges for many pieces at once: the positions of each pair, taken in ascending order of rank."""

    def __init__(self, merges: list[tuple[int, int, int]], byte_ids: list[int]):
        self.first, self.second, self.merged = (np.array(c, np.int64) for c in zip(*merges, strict=True))
        keys = self.first << 32 | self.second
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.byte_ids = np.array(byte_ids, np.int64)

    def _add(self, where: dict[int, list[np.ndarray]], left: np.ndarray, right: np.ndarray, at: np.ndarray) -> list[int]:
        """Index the pairs that have a rank; returns the ranks that weren't active."""
        keys = left << 32 | right
        slot = np.searchsorted(self.keys, keys)
        slot[slot == len(self.keys)] = 0
        known = self.keys[slot] == keys
        if not known.any():
            return []
        ranks, at = self.rank[slot[known]], at[known]
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        new = []
        starts = [0, *cuts.tolist()]
        for s, e, r in zip(starts, [*starts[1:], len(at)], ranks[starts].tolist(), strict=True):
            if r in where:
                where[r].append(at[s:e])
            else:
                where[r] = [at[s:e]]
                new.append(r)
        return new

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        if not pieces:
            return []
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1
        symbols = np.full(n + 1, -1, np.int64)  # -1 ends each piece, so no pair crosses pieces; the last cell is spare
        inner = np.ones(n, bool)
        inner[ends] = False
        symbols[:n][inner] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.minimum(np.arange(1, n + 2), n)
        before = np.arange(-1, n)
        where: dict[int, list[np.ndarray]] = {}
        at = np.arange(n)
        heap = self._add(where, symbols[:-1], symbols[1:], at)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            lists = where.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, merged = self.first[r], self.second[r], self.merged[r]
            at = at[symbols[at] == a]
            nxt = after[at]
            ok = symbols[nxt] == b
            at, nxt = at[ok], nxt[ok]
            if a == b and len(at) > 1:  # of overlapping pairs the first, third, ... of a run are merged
                t = np.arange(len(at))
                starts = np.ones(len(at), bool)
                starts[1:] = at[1:] != nxt[:-1]
                ok = (t - np.maximum.accumulate(np.where(starts, t, 0))) % 2 == 0
                at, nxt = at[ok], nxt[ok]
            if not len(at):
                continue
            beyond = after[nxt]
            symbols[at] = merged
            symbols[nxt] = -2
            after[at] = beyond
            before[beyond] = at
            back = before[at]
            left = np.concatenate([symbols[at], symbols[back]])
            right = np.concatenate([symbols[beyond], symbols[at]])
            for x in self._add(where, left, right, np.concatenate([at, back])):
                heapq.heappush(heap, x)
        kept = np.flatnonzero(symbols >= 0)
        flat = symbols[kept].tolist()
        cuts = np.searchsorted(kept, ends).tolist()
        return [flat[s:e] for s, e in zip([0, *cuts], cuts, strict=False)]


class Codec:
    """Encodes texts to ids and ids to texts with the vocabulary of one tokenizer file."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        model = j["model"]
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        by_byte = {b: vocab[c] for c, b in letters.items()}
        self.index = PairIndex([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], [by_byte[b] for b in range(256)])
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens") or ()}
        self.tokens |= {i: s.encode() for s, i in self.special.items()}
        self.by_text = {str(i): t for i, t in self.tokens.items()}
        names = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.apart = re.compile(f"({names})") if names else None
        self.cut, self.cut_latin = regex.compile(PIECES), re.compile(LATIN_PIECES)
        self.known: dict[bytes | str, str] = {}  # pieces of Latin-1 texts as bytes, others as strings

    def _cut(self, text: str) -> list[bytes | str]:
        try:
            return self.cut_latin.findall(text.encode("latin-1"))
        except UnicodeEncodeError:
            return self.cut.findall(text)

    def pieces(self, text: str) -> list[bytes | str]:
        """A text's pieces in order; a special token is a piece of its own, marked by a tuple."""
        if not self.apart or not self.apart.search(text):
            return self._cut(text)
        out: list = []
        for part in self.apart.split(text):
            out += [(part,)] if part in self.special else self._cut(part)
        return out

    def learn(self, pieces: set) -> None:
        """Encode the pieces that aren't known yet, all in one index."""
        known = self.known
        new = [p for p in pieces if p not in known]
        for p in [p for p in new if type(p) is tuple]:
            known[p] = str(self.special[p[0]])
        new = [p for p in new if type(p) is not tuple]
        raw = [p.decode("latin-1").encode() if type(p) is bytes else p.encode("utf-8", "replace") for p in new]
        for p, ids in zip(new, self.index.encode(raw), strict=True):
            known[p] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, in decimals joined by commas. Very long texts are cut where pieces end for certain."""
        if any(len(t) > LONG for t in texts):
            return [",".join(x for part in parts(t) for x in self._encode([part]) if x) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[str]:
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        self.learn(set().union(*cut))
        known = self.known.__getitem__
        return [",".join(map(known, p)) for p in cut]

    def decode(self, ids: str) -> str:
        """The text of ids in decimals joined by commas; ids without a token add nothing, broken UTF-8 is replaced."""
        if not ids:
            return ""
        try:
            raw = b"".join(map(self.by_text.__getitem__, ids.split(",")))
        except KeyError:
            raw = b"".join(self.by_text.get(i, b"") for i in ids.split(","))
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(spec: bytes) -> Codec:
    return Codec(spec)


def read_spec(path: str) -> bytes:
    """The tokenizer file; its size is bounded by the vocabulary, so it may be sent to every executor."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, n_tokens for every row. A null text counts as empty; rows may repeat; no other column is read."""
    sent = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        for batch, texts in batches(rows):
            ids = [[int(x) for x in s.split(",")] if s else [] for s in c.encode([(t or b"").decode("utf-8", "replace") for t in texts])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())],
                ["id", "ids", "n_tokens"],
            )

    kind = dict(docs.dtypes)[id_col]
    picked = bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    return picked.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens bigint").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text for every row of ids. Null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        for batch in rows:
            texts = [c.decode(",".join(map(str, ids or ()))) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    picked = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return picked.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the text decoded from the ids) for every row, in one pass per text.

    A null text counts as empty; bytes that aren't UTF-8 are read as the replacement character. Rows may repeat.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        for batch, texts in batches(rows):
            n, ids_sha, text_sha = [], [], []
            for ids in c.encode([(t or b"").decode("utf-8", "replace") for t in texts]):
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = bounded(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")))
    kind = dict(docs.dtypes)["doc_id"]
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), default_tokenizer())
