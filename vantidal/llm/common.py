"""What the operators on documents share: Arrow passes, held-out rows, word hashes."""

from __future__ import annotations

import ctypes
import re
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed on in slices of about this many bytes, whatever size the Arrow batches have.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch that Spark sends to Python, about (its own bound is 64 MB); one longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """The frame; its session's Arrow batches are bounded from now on, unless the user has set a bound."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "67108864b") == "67108864b":
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def is_held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2 never teach a model; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(sizes: Iterable[int], most: int = SLICE_BYTES) -> Iterator[slice]:
    """Consecutive runs of rows that together hold about `most` bytes; one longer text is a run of its own."""
    start = held = i = 0
    for i, n in enumerate(sizes, 1):
        held += n
        if held >= most:
            yield slice(start, i)
            start, held = i, 0
    if start < i:
        yield slice(start, i)


def give_back() -> None:
    """Hand freed memory back to the system: a worker is used again by other stages, and the driver lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def batches(rows: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Arrow batches cut into bounded slices, each with its texts as bytes. After the last the word memories are emptied,
    so a worker that is used again doesn't hold those of several operators."""
    for batch in rows:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for s in slices(sizes):
            yield batch.slice(s.start, s.stop - s.start), as_bytes(column.slice(s.start, s.stop - s.start))
    for words in _MEMORIES:
        words.clear()
    give_back()


_MEMORIES: weakref.WeakSet = weakref.WeakSet()


class Words(dict):
    """From a word to a value computed once; forgets everything beyond `most` words, so memory is bounded."""

    __hash__ = object.__hash__

    def __init__(self, value: Callable[[bytes], int], most: int = 200_000):
        self.value, self.most = value, most
        _MEMORIES.add(self)

    def __missing__(self, word: bytes) -> int:
        v = self.value(word)
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = v
        return v


#: A longer text is split into words by runs of about this many bytes.
RUN_BYTES = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def runs(text: bytes) -> Iterator[bytes]:
    """A text in runs that end at blanks, so that a very long one is never split into words as a whole."""
    at = 0
    while len(text) - at > RUN_BYTES:
        m = _BLANK.search(text, at + RUN_BYTES)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def word_values(texts: list[bytes | None], values: Words, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The value of each word (bytes between ASCII blanks) of all texts, and the number of words of each text."""
    parts: list[np.ndarray] = []
    found: list[bytes] = []
    counts = []
    get = values.__getitem__
    for t in texts:
        n = 0
        for run in runs(t) if t else ():
            w = (run.lower() if lower else run).split()
            found += w
            n += len(w)
            if len(found) > 1 << 18:
                parts.append(np.fromiter(map(get, found), np.uint64, len(found)))
                found = []
        counts.append(n)
    parts.append(np.fromiter(map(get, found), np.uint64, len(found)))
    return np.concatenate(parts) if len(parts) > 1 else parts[0], np.array(counts, np.int64)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds) over unsigned integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- Joins that send few texts ---------------------------------------------------------------------

#: Bits of the map that says which ids may be asked for: 2048 pieces of 4 kB, whatever the number of ids.
MAP_BITS = 1 << 26


def _mapped(docs: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """The rows with a column `__map`, and a condition that holds for every row whose key is among `ids` (and by chance for
    some others). The broadcast map has 8 MB at most."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS)).cast("long")
    bits = ids.select(place(F.col(key)).alias("h"))
    bits = bits.select(F.shiftright("h", 15).alias("__piece"), F.col("h").bitwiseAND(F.lit(32767)).alias("at")).repartition("__piece")
    pieces = bits.groupBy("__piece").agg(F.expr("bitmap_construct_agg(at)").alias("__map"))
    h = place(F.col(key))
    at = h.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("__map", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.bit_get(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    rows = docs.withColumn("__piece", F.shiftright(h, 15)).join(F.broadcast(pieces), "__piece", "left").drop("__piece")
    return rows, F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()


def asked_for(docs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key may be among `ids`, without a shuffle. Some others come along: an exact join follows."""
    rows, hit = _mapped(docs, ids, key)
    return rows.filter(hit).drop("__map")


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among `ids` (null keys stay). Only rows that the map points at are shuffled."""
    rows, hit = _mapped(docs, ids, key)
    clear, others = rows.filter(~hit).drop("__map"), rows.filter(hit).drop("__map")
    return clear.unionByName(others.join(ids.select(key).distinct(), key, "left_anti").select(*clear.columns))
