"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

A document's set is its distinct word shingles (64-bit hashes). The sketch is filled in rounds: in round
i every element is hashed to one of t bins with a value that grows with i, and each bin keeps its least
value; from round t on bin i - t takes the least value of all elements, so after 2t rounds every
coordinate is filled for certain, and large sets are done after one or two rounds. Coordinates agree
with the probability of the Jaccard similarity and concentrate around it as those of t independent
minima do.

Plan, in terms of distinct sets (copies meet by their set's hash and cost nothing further):

1. bands of the sketch are buckets; each bucket gives pairs of its least document with the others (a star);
2. pairs that set sizes and sketches don't rule out are verified on full sets, and verified links are joined to
   components; before that no text moves, and then only those of the pairs left;
3. buckets whose members still lie in several components are compared block by block: sketches first, then
   the full sets of those members that have a likely partner in another component, all pairs of a block at
   once as a matrix product. A block gives back the links that join its components, no candidates.

No step emits all pairs of a bucket, and no bucket is capped: the blocks of step 3 cover it whole.
With 40 bands of 6 rows a pair at similarity 0.85 shares no bucket with probability below 1e-8, and at the sketch's cut
another share of about 1e-6 is lost. `Linking(exact=True)` loses none: buckets are then the shingles of each set's prefix (of
two sets that are similar enough the prefixes share one), and no pair is ruled out by its sketches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.llm.common import Words, as_bytes, asked_for, batches, bounded, documents, mix, word_hash, word_values
from vantidal.session import forget, through_store

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Linking:
    """Production parameters."""

    words: int = 5
    percent: int = 85  #: link where 100 * intersection >= percent * union
    bands: int = 40
    rows: int = 6
    seed: int = 0x5EED
    cut: float = 0.72  #: agreement of sketches below which a pair can't reach 0.85 (5 deviations)
    block: int = 512  #: members of a bucket compared with as many others at once
    fan: int = 512  #: pairs of one document verified by one task at most
    exact: bool = False  #: buckets that miss no link, at the cost of more of them for long texts

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def least(self) -> int:
        """Smaller sets can only be linked with equal ones: the union of two others holds one element more at least."""
        return next(n for n in range(1, 1000) if 100 * n >= self.percent * (n + 1))

    def prefix(self, n: int) -> int:
        """Two sets of which one has n elements share an element of their prefixes if they are similar enough: they share
        percent / 100 of n at least, so among all but that many and one of the least (by one hash for all) is a common one."""
        return n - -(-self.percent * n // 100) + 1


# --- Sets and sketches -------------------------------------------------------------------------

_words = Words(word_hash)


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased.

    A text of fewer words has its whole sequence as one shingle; without words the set is empty.
    """
    h, counts = word_values(texts, _words, lower=True)  # of bytes only ASCII letters and blanks count
    m = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * m + h[k : k + len(rolled)]
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            one = n
            for x in h[at : at + n].tolist():
                one = (one * int(m) + x) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def fast_sketches(sets: list[np.ndarray], size: int, seed: int) -> np.ndarray:
    """A row of `size` coordinates for each set (none may be empty)."""
    out = np.full((len(sets), size), EMPTY, np.uint64)
    alive = np.arange(len(sets))
    lengths = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    flat = out.reshape(-1)
    low = np.uint64(0xFFFFFFFF)
    for i in range(2 * size):
        if not len(alive):
            break
        salt = mix(np.array([(seed << 20) + i + 1], np.uint64))[0]
        x = mix(elements ^ salt)
        value = (np.uint64(i) << np.uint64(32)) | (x & low)
        if i < size:
            bins = ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            np.minimum.at(flat, np.repeat(alive, lengths) * size + bins.astype(np.int64), value)
        else:
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            out[alive, i - size] = np.minimum(out[alive, i - size], np.minimum.reduceat(value, starts))
        left = (out[alive] == EMPTY).any(axis=1)
        if not left.all():
            elements = elements[np.repeat(left, lengths)]
            alive, lengths = alive[left], lengths[left]
    return out


def buckets(p: Linking) -> Column:
    """The hash of each band of a sketch, with the band's number; or the set's prefix."""
    if p.exact:
        return F.col("prefix")
    sketch = F.col("sketch")
    return F.array(*(F.xxhash64(F.lit(i), F.substring(sketch, i * p.rows + 1, p.rows)) for i in range(p.bands)))


def sketch_documents(docs: DataFrame, p: Linking) -> DataFrame:
    """id, n (set size), s1 and s2 (the set's hash), sketch (a byte of each coordinate; null for sets too small to be linked)
    and prefix (null unless links are to be exact)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(rows):
            sets = shingle_sets(texts, p.words)
            n = np.array([len(s) for s in sets], np.int64)
            s1 = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], np.uint64)
            s2 = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            large = np.flatnonzero(n >= p.least)
            bytes_: list = [None] * len(sets)
            prefixes: list = [None] * len(sets)
            if len(large):
                sk = fast_sketches([sets[i] for i in large], p.size, p.seed)
                for i, raw in zip(large.tolist(), (sk & np.uint64(255)).astype(np.uint8), strict=True):
                    bytes_[i] = raw.tobytes()
                for i in large.tolist() if p.exact else ():
                    prefixes[i] = sets[i][: p.prefix(len(sets[i]))].view(np.int64)  # sets are in order of their hashes
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(bytes_, pa.binary()),
                 pa.array(prefixes, pa.list_(pa.int64()))], ["id", "n", "s1", "s2", "sketch", "prefix"],
            )

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"id {kind}, n bigint, s1 bigint, s2 bigint, sketch binary, prefix array<bigint>")


# --- Components --------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """id and comp (the least id reachable) for every id in links (a, b): large-star and small-star in turn.

    All steps are joins and combinable minima; each round is written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = through_store(edges, "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A stored side, so that a node with many neighbours is a skewed key that is split.
        least = through_store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        centre = least
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, through_store(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(old, centre)
        now = mark(edges)
        if now == before:
            break
        before = now
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    out._stored_at = edges._stored_at
    return out


# --- Verification ------------------------------------------------------------------------------


def likely_pairs(pairs: DataFrame, sketches: DataFrame, p: Linking) -> DataFrame:
    """Those of the pairs (a, b) whose set sizes and sketches don't rule a link out; no text is looked at.

    `sketches` has id, n and sketch, an id once or with several texts.
    """
    of = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    sizes = 100 * F.least("n_a", "n_b") >= p.percent * F.greatest("n_a", "n_b")
    both = pairs.join(of("b"), "b").join(of("a"), "a").filter(sizes).select("a", "b", "s_a", "s_b")
    need = 0 if p.exact else p.cut * p.size  # only low bytes are compared: unequal coordinates agree once in 256

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, p.size) for c in ("s_a", "s_b"))
            keep = pa.array((x == y).sum(axis=1) >= need)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    kind = dict(pairs.dtypes)["a"]
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, docs: DataFrame, p: Linking) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar enough.

    Each pair sends one text to its document a. A document with many pairs is dealt to several tasks. Of `docs` (id,
    text) only rows that a pair may ask for are shuffled.
    """
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / p.fan).cast("int").alias("fans"))
    dealt = pairs.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), "fans").cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("id"))
    heads = fans.select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("id"))
    asked = through_store(heads.union(dealt), "asked")
    sent = asked.join(asked_for(docs, asked), "id").select("a", "part", "role", F.col("id").alias("b"), "text")
    sent = sent.repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads_ = None, []
        for batch, raw in batches(rows):
            a, part = batch.column("a").to_pylist(), batch.column("part").to_pylist()
            role, b = batch.column("role").to_pylist(), batch.column("b").to_pylist()
            out = []
            for x, k, r, y, s in zip(a, part, role, b, shingle_sets(raw, p.words), strict=True):
                if (x, k) != key:
                    key, heads_ = (x, k), []
                if not r:
                    heads_.append(s)
                    continue
                for h in heads_:
                    if 100 * min(len(h), len(s)) < p.percent * max(len(h), len(s)):
                        continue
                    shared = len(np.intersect1d(h, s, assume_unique=True))
                    if 100 * shared >= p.percent * (len(h) + len(s) - shared) > 0:
                        out.append((x, y))
                        break
            if out:
                kinds = batch.schema.field("a").type
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds) for i in (0, 1)], ["a", "b"])

    kind = dict(pairs.dtypes)["a"]
    out = sent.mapInArrow(run, f"a {kind}, b {kind}")
    out._reads = (asked,)
    return out


# --- Buckets whose members lie in several components ---------------------------------------------


def _groups(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """gid, id, comp: the groups within which documents of different components must be compared.

    Such a group is a bucket; or all documents that such buckets connect, where comparing those once takes
    fewer comparisons than comparing them in each of their buckets.
    """
    of = shared.join(comp, "id", "left").select("bucket", "a", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = of.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("k")).filter("x < y")
    of = through_store(of.join(mixed.select("bucket", "k"), "bucket"), "mixed")
    joined = components(of.select("a", F.col("id").alias("b")).filter("a <> b")).withColumnRenamed("comp", "cluster")
    ids = of.select("id").distinct().join(joined, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    ids = through_store(ids, "clusters")
    heads = of.join(ids, "id").groupBy("bucket").agg(F.first("cluster").alias("cluster"), F.first("k").alias("k"))
    work = heads.groupBy("cluster").agg(F.sum(F.col("k") * F.col("k")).alias("buckets"))
    size = ids.groupBy("cluster").agg(F.count("*").alias("c"))
    whole = size.join(work, "cluster").select("cluster", (F.col("c") * F.col("c") <= F.col("buckets")).alias("whole"))
    of = of.join(ids.join(whole, "cluster"), "id")  # a cluster's documents, not its buckets' rows, meet its key
    gid = F.when(F.col("whole"), F.xxhash64(F.lit("cluster"), "cluster")).otherwise(F.xxhash64(F.lit("bucket"), "bucket"))
    return through_store(of.select(gid.alias("gid"), "id", "comp").distinct(), "groups")


def _block_keys(p: Linking) -> Column:
    """The comparisons that a member takes part in. Members of a group's main component meet the blocks of all
    others, never one another; the others meet block by block."""
    mains = F.ceil(F.col("main_n") / p.block).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("main_n")) / p.block).cast("int"))
    h = F.xxhash64("id")
    chunk, block = F.pmod(h, mains).cast("int"), F.pmod(h, blocks).cast("int")
    to_blocks = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(i.alias("i"), (-1 - chunk).alias("j")))
    to_mains = F.transform(F.sequence(F.lit(0), mains - 1), lambda j: F.struct(block.alias("i"), (-1 - j).alias("j")))
    to_others = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(i, block).alias("i"), F.greatest(i, block).alias("j"))
    )
    return F.when(F.col("comp") == F.col("main"), to_blocks).otherwise(F.concat(to_mains, to_others))


def _by_block(rows: DataFrame, columns: list[str], schema: str, each) -> DataFrame:
    """Rows of one block (gid, i, j) together, handed to `each` as lists; it yields rows of the schema."""
    rows = rows.select("gid", "i", "j", *columns).repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j", "id")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kinds = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            out = each(key, [list(c) for c in zip(*held, strict=True)]) if len(held) > 1 else []
            if out:
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[n]) for n, c in zip(names, cols, strict=True)], names)

        for batch in it:
            f = batch.schema
            kinds = {"gid": pa.int64(), "i": pa.int32(), "j": pa.int32(), "a": f.field("id").type, "b": f.field("id").type}
            kinds |= {c: f.field(c).type for c in ("id", "comp")}
            values = [as_bytes(batch.column(c)) if c == "text" else batch.column(c).to_pylist() for c in columns]
            keys = zip(*(batch.column(c).to_pylist() for c in ("gid", "i", "j")), strict=True)
            for k, *row in zip(keys, *values, strict=True):
                if k != key:
                    yield from done()
                    key, held = k, []
                held.append(row)
        yield from done()

    return rows.mapInArrow(run, schema)


def _likely(groups: DataFrame, sketches: DataFrame, p: Linking) -> DataFrame:
    """gid, i, j, id, comp of the members of a block that have a like sketch in another component there."""
    sizes = groups.groupBy("gid", "comp").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("gid").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("size"))
    sizes = sizes.select("gid", "size", F.col("top.comp").alias("main"), F.col("top.k").alias("main_n"))
    sizes = through_store(sizes, "sizes")  # a stored side, so that a large group is a skewed key that is split
    rows = groups.join(sizes, "gid").select("gid", "id", "comp", F.explode(_block_keys(p)).alias("key"))
    rows = rows.select("gid", "key.i", "key.j", "id", "comp").join(sketches, "id")
    need = 0 if p.exact else p.cut * p.size

    def each(key: tuple, columns: list[list]) -> list[tuple]:
        ids, comps, raw = columns
        sk = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        comp = np.unique(np.array(comps), return_inverse=True)[1]
        hit = np.zeros(len(sk), bool)
        for s in range(0, len(sk), 16):
            agree = (sk[s : s + 16, None, :] == sk[None, s:, :]).sum(axis=2, dtype=np.int32)
            ok = (agree >= need) & (comp[s : s + 16, None] != comp[None, s:])
            hit[s : s + 16] |= ok.any(axis=1)
            hit[s:] |= ok.any(axis=0)
        return [(*key, ids[x], comps[x]) for x in np.flatnonzero(hit)]

    kind = dict(groups.dtypes)["id"]
    out = _by_block(rows, ["id", "comp", "sketch"], f"gid bigint, i int, j int, id {kind}, comp {kind}", each)
    out._reads = (sizes,)
    return out


def shared_counts(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """The intersection size of every two sets: products of membership matrices over the elements that any two share."""
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    keep = counts[at] > 1
    own, at = own[keep], number[at[keep]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, chunk):
        a, z = np.searchsorted(at, [lo, lo + chunk])
        m = np.zeros((len(sets), chunk), np.float32)
        m[own[a:z], at[a:z] - lo] = 1
        out += m @ m.T  # whole numbers below 2**24: exact
    return out


def _links_apart(likely: DataFrame, docs: DataFrame, p: Linking) -> DataFrame:
    """Verified links (a, b) between components: of each block as many as join what it can join."""

    def each(key: tuple, columns: list[list]) -> list[tuple]:
        ids, comps, raw = columns
        sets = shingle_sets(raw, p.words)
        comp = np.unique(np.array(comps), return_inverse=True)[1]
        n = np.array([len(s) for s in sets], np.float64)
        both = shared_counts(sets)
        linked = (100 * both >= p.percent * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :])
        root = list(range(int(comp.max()) + 1))

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for x, y in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            cx, cy = top(int(comp[x])), top(int(comp[y]))
            if cx != cy and ids[x] != ids[y]:
                root[cx] = cy
                out.append(tuple(sorted((ids[x], ids[y]))))
        return out

    kind = dict(likely.dtypes)["id"]
    rows = likely.join(asked_for(docs, likely.select("id")), "id")
    return _by_block(rows, ["id", "comp", "text"], f"a {kind}, b {kind}", each)


# --- The operator --------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, linking: Linking | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id reachable through links) and kept (id = component_id), a row for each row.

    Null or blank texts have an empty set and are linked with nothing. Rows with a null id are linked with
    nothing, have a null component and are kept. Rows that repeat an id stay rows; the id's links are those of
    all its texts. Only the id and the text are read, whatever other columns are called.
    """
    p = linking or Linking()
    docs = bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    sk = through_store(sketch_documents(docs, p), "sketches")

    # Classes of equal sets; only those of several ids need a representative. The join's sides are stored, so a class
    # with a third of all rows is a skewed key that adaptive execution splits.
    classes = sk.filter("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.max("id").alias("top"))
    classes = through_store(classes.filter("rep < top").drop("top"), "classes")
    of = sk.join(classes, ["n", "s1", "s2"], "left").withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
    first = F.col("id") == F.col("rep")
    of = through_store(of.select("id", "n", "rep", F.when(first, F.col("sketch")).alias("sketch"), F.when(first, F.col("prefix")).alias("prefix")), "members")
    forget(sk, classes)
    # An id that repeats with different texts belongs to several classes, which it joins.
    many = of.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("id", "a")
    many = of.select("id", "rep").join(many, "id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()

    # A class is its representative's sketch. Buckets with several ids are kept: their head and all their members.
    own = of.filter("sketch IS NOT NULL").select("id", "n", "sketch")
    cells = of.filter("sketch IS NOT NULL").select("id", F.explode(buckets(p)).alias("bucket"))
    heads = cells.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("bucket", "a")
    heads = through_store(heads, "heads")
    shared = through_store(cells.join(heads, "bucket").select("bucket", "a", "id"), "buckets")
    forget(heads)
    sketches = through_store(own.join(shared.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "sketch"]), "sketches")

    star = through_store(shared.filter("a <> id").select("a", F.col("id").alias("b")).distinct(), "pairs")
    pairs = through_store(likely_pairs(star, sketches, p).distinct(), "pairs")
    forget(star)
    real = verified(pairs, docs, p)
    links = through_store(real.union(many), "links")
    forget(pairs, real)
    comp = components(links)
    groups = _groups(shared, comp)
    found = _likely(groups, sketches, p)
    likely = through_store(found, "likely")
    forget(found, groups, shared, sketches)
    if not likely.isEmpty():
        more = through_store(_links_apart(likely, docs, p), "links")
        if not more.isEmpty():
            first, comp = comp, components(links.union(more))
            forget(first)
        forget(more)
    forget(likely, links)
    found = comp.select(F.col("id").alias("rep"), "comp")
    out = of.join(found, "rep", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id")
    )
    out = out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    out._reads = (of, comp)
    return out


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
