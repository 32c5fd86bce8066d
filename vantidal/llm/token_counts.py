"""Token counts by a separator scan of flat, unindexed token files.

A token file is a run of little-endian 16- or 32-bit ids; each document ends with an end-of-document id,
and nothing says where documents begin. Files are read in blocks. In a block the separators are found
by one vectorised comparison, which gives the counts of all documents that begin and end in it. What
crosses block boundaries is stitched by a scan over the blocks' summaries (separators, tokens before the
first, position of the first), one small row a block: the open end of a block is closed by the first
separator of the blocks after it, and the running number of separators numbers the documents.

`write_token_files` writes such files through Spark's text writer, with the separator as line end: a row is a run of
documents as bytes and becomes a file, so files are bounded in bytes, tasks can fail and repeat, and any store that Spark
writes to will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantidal.llm.common import batches, bounded, documents
from vantidal.session import delete_on_exit, shared_dir


@dataclass(frozen=True)
class Files:
    """How the token files are laid out. The separator is id 0; other ids are stored with 1 added."""

    width: int = 2  #: bytes a token
    eod: int = 0
    header: int = 5  #: tokens before each document's own: its row id in digits of 15 bits, each with 1 added
    block: int = 1 << 20  #: bytes scanned at once
    bytes: int = 32 << 20  #: of a file, beside its last document

    @property
    def kind(self) -> str:
        return f"<u{self.width}"


_encodings: dict[bytes, object] = {}


def _encoding(spec: bytes):
    """The tokenizer of a vocabulary of ranks, made once a worker."""
    if spec not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in spec.splitlines() if line)}
        _encodings.clear()
        _encodings[spec] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[spec]


#: Set in the last digit of a row without an id (64 bits of an id take four bits of the fifth digit).
NO_ID = 1 << 14


def id_digits(ids: np.ndarray, missing: np.ndarray, n: int) -> np.ndarray:
    """Whole numbers as n digits of 15 bits, with 1 added so that none is the separator."""
    u = ids.astype(np.int64).view(np.uint64)
    shifts = np.arange(n, dtype=np.uint64) * np.uint64(15)
    out = ((u[:, None] >> shifts) & np.uint64(0x7FFF)).astype(np.int64) + 1
    out[missing, -1] += NO_ID
    return out


def check_width(vocabulary: bytes, width: int) -> None:
    """Refuse a vocabulary whose ids, with 1 added, don't fit the width."""
    most = max((int(line.split()[1]) for line in vocabulary.splitlines() if line), default=0)
    if most + 1 >= 1 << 8 * width:
        raise ValueError(f"token {most} doesn't fit {width} bytes")


def write_token_files(docs: DataFrame, path: str, vocabulary: str, files: Files | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise every row (a null text has no tokens) and write the flat files to `path`.

    A null id is marked as such; an id that isn't a whole number counts as null. Rows may repeat. A file has `bytes` bytes
    and its last document's at most. The vocabulary's size bounds what is sent to executors; its ids must fit the width.
    """
    f = files or Files()
    with open(vocabulary, "rb") as v:
        spec = v.read()
    check_width(spec, f.width)
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    end = b"\0" * f.width

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(sent.value)
        parts: list[bytes] = []
        size = 0

        def file() -> pa.RecordBatch:  # the writer adds the last separator
            return pa.RecordBatch.from_arrays([pa.array([end.join(parts)], pa.binary())], ["tokens"])

        for batch, texts in batches(rows):
            ids = batch.column("id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            heads = id_digits(ids.fill_null(0).to_numpy(), missing, f.header)
            for head, t in zip(heads, texts, strict=True):
                tokens = enc.encode_to_numpy(t.decode("utf-8", "replace"), disallowed_special=()) if t else np.empty(0, np.int64)
                parts.append(np.concatenate([head, tokens.astype(np.int64) + 1]).astype(f.kind).tobytes())
                size += len(parts[-1])
                if size >= f.bytes:
                    yield file()
                    parts, size = [], 0
        if parts:
            yield file()

    whole = F.col(id_col).try_cast("long")
    picked = bounded(docs.select(whole.alias("id"), F.col(text_col).cast("string").alias("text")))
    rows = picked.mapInArrow(run, "tokens binary")
    # The text writer puts a string's bytes as they are, then the line end.
    rows.select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", "\0" * f.width).option("maxRecordsPerFile", 1).text(path)
    sent.destroy()


def scan_token_files(spark: SparkSession, path: str, files: Files | None = None) -> DataFrame:
    """A row for each document of the files: file, ordinal in the file (from 0), start (in tokens), n_tokens
    (with the header's) and its first `header` tokens.

    Tokens after a file's last separator are no document. Empty files and an empty folder give no rows. A file
    whose size isn't a multiple of the token width is refused, and so is one over 2 GB (Spark reads a file as a row;
    `write_token_files` writes small ones).
    """
    f = files or Files()
    per = f.block // f.width
    ahead = f.header * f.width  # a document that begins at a block's end has its header in the next block
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    cut = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / f.block).cast("long"))
    part = F.transform(
        cut,
        lambda b: F.struct(b.alias("block"), F.substring(F.col("content"), (b * f.block + 1).cast("int"), F.lit(f.block + ahead)).alias("raw")),
    )
    blocks = raw.filter("length > 0").select("path", "length", F.explode(part).alias("b")).select("path", "b.block", "length", "b.raw")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                file, block, length = (batch.column(c)[i].as_py() for c in ("path", "block", "length"))
                if length % f.width:
                    raise ValueError(f"{file} has {length} bytes, no multiple of {f.width}")
                tokens = np.frombuffer(batch.column("raw")[i].as_py(), f.kind)
                own = tokens[:per]
                ends = np.flatnonzero(own == f.eod)
                base = block * per
                # Documents begin at the file's start and after each separator, unless the file ends there.
                starts = np.concatenate([[0] if block == 0 else [], ends + 1]).astype(np.int64)
                if len(starts) and base + starts[-1] >= length // f.width:
                    starts = starts[:-1]
                closed = np.searchsorted(ends, starts)  # the separator that ends each, if it is in this block
                inside = closed < len(ends)
                n = np.full(len(starts), -1, np.int64)
                n[inside] = ends[closed[inside]] - starts[inside]
                at = starts[:, None] + np.arange(f.header)
                head = np.where(at < len(tokens), tokens[np.minimum(at, len(tokens) - 1)], 0).astype(np.int64)
                # The block's summary is the first row; start and first are positions in the file.
                first = base + int(ends[0]) if len(ends) else None
                k = len(starts) + 1
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), head.reshape(-1)]))
                offsets = pa.array(np.concatenate([[0], np.arange(k) * f.header]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * k, pa.string()), pa.array(np.full(k, block)), pa.array([len(ends)] + [None] * (k - 1), pa.int64()),
                     pa.array([first] + [None] * (k - 1), pa.int64()), pa.array(np.concatenate([[-1], base + starts])),
                     pa.array(np.concatenate([[-1], n])), pa.array(np.concatenate([[-1], np.arange(len(starts))])),
                     pa.ListArray.from_arrays(offsets, flat)],
                    ["file", "block", "ends", "first", "start", "n", "nth", "head"],
                )

    schema = "file string, block bigint, ends bigint, first bigint, start bigint, n bigint, nth bigint, head array<bigint>"
    rows = blocks.mapInArrow(run, schema)
    # The scan: a file's blocks in order. Rows of a block follow its summary; nothing else is needed of other blocks.
    summary = rows.filter("start = -1").select("file", "block", "ends", "first")
    ahead_ = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = summary.select(
        "file", "block", F.min("first").over(ahead_).alias("closes"), F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("seen")
    )
    whole = rows.filter("start >= 0").join(stitched, ["file", "block"])
    n = F.when(F.col("n") >= 0, F.col("n")).otherwise(F.col("closes") - F.col("start"))
    # The nth start of a block: block 0 begins with the file's start, others with their first separator.
    ordinal = F.col("seen") + F.col("nth") + F.when(F.col("block") == 0, 0).otherwise(1)
    return whole.select("file", ordinal.alias("ordinal"), "start", n.alias("n_tokens"), "head").filter("n_tokens IS NOT NULL")


def count_tokens(docs: DataFrame, vocabulary: str, files: Files | None = None) -> DataFrame:
    """doc_id and n_tokens for every row, by writing its token files and scanning them. Empty texts have 0 tokens.

    Null ids stay null (and ids that aren't whole numbers become so); rows that repeat are counted each.
    """
    f = files or Files()
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    write_token_files(docs, path, vocabulary, f)
    found = scan_token_files(spark, path, f)
    digit = lambda i: (F.get("head", F.lit(i)) - 1).cast("long")
    doc_id = digit(0)
    for i in range(1, f.header):
        doc_id = doc_id.bitwiseOR(F.shiftleft(digit(i).bitwiseAND(F.lit(NO_ID - 1)) if i == f.header - 1 else digit(i), 15 * i))
    there = digit(f.header - 1) < NO_ID
    return found.select(F.when(there, doc_id).alias("doc_id"), (F.col("n_tokens") - f.header).alias("n_tokens"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
