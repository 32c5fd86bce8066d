"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments, each with a table from its value to the codes that have it. A
query looks up its segments' values, then all values one bit off, then two, and so on. After radius r in
every segment all codes within segments * (r + 1) - 1 bits have been met (some segment differs by r at
most, or the distance would be segments * (r + 1)). The search ends when the kth verified distance is
within that bound, so the answer is exact.

Every row is indexed: rows are dealt by the hash of their id to blocks of bounded size, and every query goes to every block
as a row of the same shuffle, so one plan holds any number of both and the driver holds none. A task builds a block's
tables, searches them for the queries that follow, and returns k rows a query, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS = 64


@dataclass(frozen=True)
class Search:
    """Production parameters."""

    k: int = 10
    segments: int = 4
    rows: int = 1 << 20  #: of a block, about: 70 MB with its tables


def sign_code(vector: Column) -> Column:
    """64 bits, one a dimension: set where the value is above 0. Null for null vectors; a longer vector is refused."""
    signed = [1 << i if i < 63 else -(1 << 63) for i in range(BITS)]
    masks_ = F.array(*(F.lit(m).cast("long") for m in signed))
    bits = F.transform(masks_, lambda m, i: F.when(F.get(vector, i) > 0, m).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    too_long = F.raise_error(F.lit(f"a vector has more than {BITS} dimensions")).cast("long")
    return F.when(vector.isNotNull(), F.when(F.size(vector) > BITS, too_long).otherwise(code))


@lru_cache(maxsize=256)
def masks(width: int, radius: int) -> np.ndarray:
    """All values of `width` bits with `radius` ones."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.uint64)


class Index:
    """The segment tables of a block of codes."""

    def __init__(self, codes: np.ndarray, segments: int):
        self.codes, self.segments, self.width = codes, segments, BITS // segments
        self.low = np.uint64((1 << self.width) - 1)
        self.tables = []
        for s in range(segments):
            value = (codes >> np.uint64(s * self.width)) & self.low
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], np.arange((1 << self.width) + 1, dtype=np.uint64))
            self.tables.append((order, starts))

    def around(self, code: np.uint64, radius: int) -> np.ndarray:
        """The positions of the codes with a segment that is exactly `radius` bits off; some more than once."""
        out = []
        for s, (order, starts) in enumerate(self.tables):
            values = (((code >> np.uint64(s * self.width)) & self.low) ^ masks(self.width, radius)).astype(np.int64)
            first, last = starts[values], starts[values + 1]
            held = last > first
            out += [order[a:b] for a, b in zip(first[held].tolist(), last[held].tolist(), strict=True)]
        return np.concatenate(out) if out else np.empty(0, np.int64)


def search(index: Index, ids: np.ndarray, code: np.uint64, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least (distance, id) of `best` and the block's codes."""
    dist, names = best
    met = np.zeros(len(index.codes), bool)
    for radius in range(index.width + 1):
        # All within segments * radius - 1 bits have been met.
        if len(dist) == k and dist[-1] <= index.segments * radius - 1:
            break
        at = index.around(code, radius)
        at = np.unique(at[~met[at]])
        if not len(at):
            continue
        met[at] = True
        d = np.bitwise_count(index.codes[at] ^ code).astype(np.int64)
        if len(dist) == k:
            near = d <= dist[-1]
            d, at = d[near], at[near]
        dist, names = np.concatenate([dist, d]), np.concatenate([names, ids[at]])
        both = np.unique(np.stack([dist, names]), axis=1)[:, :k]  # in order; a row that repeats in blocks counts once
        dist, names = both[0], both[1]
    return dist, names


def top_k(rows: DataFrame, queries: DataFrame, search_: Search | None = None) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k rows of least (distance, id) for each query.

    `rows` and `queries` have id (whole numbers; others count as null) and code (64 bits); a query that is itself a row
    finds itself. Rows with a null id or code are left out, as are such queries. Fewer than k rows give fewer.
    Repeated rows count once; an id with several codes counts once for each of its distances.
    """
    p = search_ or Search()
    whole = lambda df: df.select(F.col("id").try_cast("long").alias("id"), F.col("code").cast("long")).filter("id IS NOT NULL AND code IS NOT NULL")
    rows, queries = whole(rows), whole(queries).distinct()
    blocks = max(-(-rows.count() // p.rows), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "id", "code")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "id", "code")
    both = dealt.union(asked).repartitionByRange(blocks, "block").sortWithinPartitions("block", "side")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index, names = None, [], None, None
        nothing = (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in it:
            numbers = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "side", "id", "code")])
            cuts = np.flatnonzero((numbers[0, 1:] != numbers[0, :-1]) | (numbers[1, 1:] != numbers[1, :-1])) + 1
            for part in np.split(numbers, cuts, axis=1):
                if part[0, 0] != key:
                    key, held, index = part[0, 0], [], None
                if part[1, 0] == 0:
                    held.append(part[2:])
                    continue
                if index is None and held:
                    own = np.unique(np.concatenate(held, axis=1), axis=1)  # a repeated row counts once
                    names, index, held = own[0], Index(own[1].view(np.uint64), p.segments), []
                if index is None:
                    continue
                for at in range(0, part.shape[1], 1024):
                    q = part[2:, at : at + 1024]
                    best = [search(index, names, c, nothing, p.k) for c in q[1].view(np.uint64)]
                    n = np.array([len(d) for d, _ in best], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(q[0], n)), pa.array(np.repeat(q[1], n)), pa.array(np.concatenate([x for _, x in best])),
                         pa.array(np.concatenate([d for d, _ in best]))], ["query_id", "query_code", "id", "distance"],
                    )

    found = both.mapInArrow(run, "query_id bigint, query_code bigint, id bigint, distance bigint")
    w = Window.partitionBy("query_id", "query_code").orderBy("distance", "id")
    return (
        found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= p.k)
        .select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")
    )


def op6_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 50, against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    out = top_k(rows, rows.filter("id % 50 = 0"))
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


SQL = """
WITH bits AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: x > 0) AS b FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         len(list_filter(list_zip(q.b, r.b), lambda z: z[1] <> z[2])) AS distance
  FROM bits q, bits r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""
