"""A session's results: immutable tables on shared storage, found by id, with what a reader should know of them.

A result is a folder of zstd Parquet and a small JSON sidecar written with Spark, so any store that Spark
writes to will do. Reads are lazy: filters and columns reach the files.
"""

from __future__ import annotations

import json
import re
import secrets
import time as clock
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.errors import Refusal
from vantidal.operators.relational import column_summary, ordered
from vantidal.plans import guard
from vantidal.session import shared_dir

ID = re.compile(r"r_[0-9a-f]{10}")
PREVIEW, GROUPS = 3, 20
INLINE_ROWS, INLINE_TOKENS = 200, 6000
#: Seconds that a query may take, that a lock holds, and after which an unfinished result is an orphan.
QUERY_SECONDS, LOCK_SECONDS, ORPHAN_SECONDS = 10, 600, 6 * 3600


@dataclass
class ColumnInfo:
    name: str
    kind: str
    nulls: int | None = None
    least: str | None = None
    greatest: str | None = None
    unit: str | None = None
    role: str | None = None


@dataclass
class Info:
    """A result's sidecar."""

    result_id: str
    tool: str
    rows: int
    size: int
    created: str
    columns: list[ColumnInfo]
    time: str | None = None
    group: str | None = None
    model: str | None = None
    parents: list[str] = field(default_factory=list)
    provenance: dict = field(default_factory=dict)
    rows_of: dict | None = None
    truncated: bool = False

    @classmethod
    def load(cls, text: str) -> Info:
        raw = json.loads(text)
        return cls(**raw | {"columns": [ColumnInfo(**c) for c in raw["columns"]]})


class ResultStore:
    """Results of one session below a folder. Nothing is shared with other sessions."""

    def __init__(self, spark: SparkSession, session: str, root: str | None = None, ttl_hours: float = 24, most_bytes: int = 5 << 30):
        if not re.fullmatch(r"[\w-]{1,64}", session):
            raise Refusal("invalid_arguments", "A session's name has letters, digits, _ and -.")
        self.spark, self.ttl, self.most = spark, timedelta(hours=ttl_hours), most_bytes
        self.root = f"{(root or shared_dir(spark)).rstrip('/')}/results/{session}"

    # The store's files are reached through Hadoop's file systems, as Spark's own are.
    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _write_text(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        raw = self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
        stream.close()
        return bytes(raw).decode()

    def put(
        self, df: DataFrame, tool: str, time: str | None = None, group: str | None = None, model: str | None = None,
        parents: list[str] = (), provenance: dict | None = None, rows_of: dict | None = None, truncated: bool = False,
    ) -> Info:
        """Write a table under a new id: to a folder aside, then renamed, so a result is whole or not there."""
        rid = "r_" + secrets.token_hex(5)
        final, aside = f"{self.root}/{rid}", f"{self.root}/.tmp-{rid}"
        df.write.option("compression", "zstd").parquet(f"{aside}/data")
        kept = self.spark.read.parquet(f"{aside}/data")
        summary = {r["column"]: r for r in column_summary(kept).collect()}  # a row for each column
        columns = [
            ColumnInfo(f.name, f.dataType.simpleString(), summary[f.name].nulls, summary[f.name].least, summary[f.name].greatest,
                       (f.metadata or {}).get("unit"), (f.metadata or {}).get("role"))
            for f in df.schema
        ]
        fs, p = self._fs(aside)
        size = fs.getContentSummary(p).getLength()
        parents = list(parents)
        cut = truncated or any(self.info(x).truncated for x in parents if x in self.live())
        info = Info(rid, tool, kept.count(), size, datetime.now(UTC).isoformat(), columns, time, group, model, parents, provenance or {}, rows_of, cut)
        self._write_text(f"{aside}/info.json", json.dumps(asdict(info)))
        fs.rename(p, self._fs(final)[1])
        with self.locked():
            self.evict(keep=rid)
        return info

    @contextmanager
    def locked(self, wait: float = 10.0) -> Iterator[None]:
        """One writer at a time: a file that only one can create. A lock that its owner left behind goes after LOCK_SECONDS."""
        fs, p = self._fs(f"{self.root}/.lock")
        until = clock.monotonic() + wait
        while True:
            try:
                fs.create(p, False).close()
                break
            except Exception as e:
                if "exist" not in str(e).lower():
                    raise
            try:
                if clock.time() - fs.getFileStatus(p).getModificationTime() / 1000 > LOCK_SECONDS:
                    fs.delete(p, False)
                    continue
            except Exception:  # it went meanwhile
                continue
            if clock.monotonic() > until:
                raise Refusal("store_busy", "Another writer holds the store.", "Try again.")
            clock.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(p, False)

    def live(self) -> list[str]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if ID.fullmatch(s.getPath().getName()))

    def info(self, rid: str) -> Info:
        if not ID.fullmatch(rid) or rid not in self.live():
            raise Refusal("sql_table", f"There is no result '{rid}'.", "List the results.")
        return Info.load(self._read_text(f"{self.root}/{rid}/info.json"))

    def list(self) -> list[Info]:
        return sorted((self.info(r) for r in self.live()), key=lambda i: (i.created, i.result_id))

    def read(self, rid: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        self.info(rid)
        df = self.spark.read.parquet(f"{self.root}/{rid}/data")
        for c in columns or ():
            if c not in df.columns:
                raise Refusal("unknown_column", f"'{rid}' has no column '{c}'.")
        df = df.select(*columns) if columns else df
        return df.limit(limit) if limit is not None else df

    def drop(self, *rids: str) -> int:
        n = 0
        for r in rids:
            if ID.fullmatch(r):
                fs, p = self._fs(f"{self.root}/{r}")
                n += bool(fs.delete(p, True))
        return n

    def usage(self) -> dict:
        infos = self.list()
        return {"results": len(infos), "bytes": sum(i.size for i in infos), "most_bytes": self.most}

    def evict(self, keep: str | None = None) -> list[str]:
        """Drop expired results; beyond the size cap the oldest, down to nine tenths of it. Also what a crash left: unfinished
        results that are older than ORPHAN_SECONDS."""
        now, gone = datetime.now(UTC), []
        fs, p = self._fs(self.root)
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName().startswith(".tmp-") and clock.time() - s.getModificationTime() / 1000 > ORPHAN_SECONDS:
                fs.delete(s.getPath(), True)
        infos = [i for i in self.list() if i.result_id != keep]
        for i in infos:
            if now - datetime.fromisoformat(i.created) > self.ttl:
                gone.append(i.result_id)
        size = self.usage()["bytes"] - sum(i.size for i in infos if i.result_id in gone)
        if size > self.most:
            for i in infos:
                if i.result_id not in gone and size > 0.9 * self.most:
                    gone.append(i.result_id)
                    size -= i.size
        self.drop(*gone)
        return gone

    def select(self, sql: str, most: int | None = None) -> DataFrame:
        """One guarded SELECT over the session's results, as a plan that hasn't run (to be stored, say)."""
        named = {t.lower() for t in re.findall(r"\br_[0-9a-f]{10}\b", sql or "", re.I)}
        return guard.run(self.spark, sql, {r: self.read(r) for r in self.live() if r in named}, most)

    def query(self, sql: str, most: int = INLINE_ROWS, seconds: float = QUERY_SECONDS) -> DataFrame:
        """One guarded SELECT over the session's results: `most` rows and one more at most, within the time."""
        if not 1 <= most <= INLINE_ROWS or not 1 <= seconds <= 120:
            raise Refusal("invalid_arguments", f"A query returns 1 to {INLINE_ROWS} rows within 1 to 120 seconds.")
        df = self.select(sql, most)
        return self.spark.createDataFrame(guard.rows_within(df, seconds), df.schema)


def ready_queries(info: Info) -> list[str]:
    """Three statements that fit the table: coverage, the latest rows and a daily summary; or a count, rows and a sample."""
    r, t, g = info.result_id, info.time, info.group
    if t and g:
        return [
            f"SELECT `{g}`, count(*) AS n, min(`{t}`) AS first, max(`{t}`) AS last FROM {r} GROUP BY ALL ORDER BY `{g}`",
            f"SELECT * FROM {r} QUALIFY row_number() OVER (PARTITION BY `{g}` ORDER BY `{t}` DESC NULLS LAST) = 1",
            f"SELECT `{g}`, date_trunc('day', `{t}`) AS day, count(*) AS n FROM {r} GROUP BY ALL ORDER BY day, `{g}`",
        ]
    if t:
        return [
            f"SELECT count(*) AS n, min(`{t}`) AS first, max(`{t}`) AS last FROM {r}",
            f"SELECT * FROM {r} ORDER BY `{t}` DESC NULLS LAST LIMIT 20",
            f"SELECT date_trunc('day', `{t}`) AS day, count(*) AS n FROM {r} GROUP BY ALL ORDER BY day",
        ]
    text = next((c.name for c in info.columns if c.kind == "string"), None)
    last = f"SELECT `{text}`, count(*) AS n FROM {r} GROUP BY ALL ORDER BY n DESC" if text else f"SELECT * FROM {r} USING SAMPLE 20 ROWS REPEATABLE (42)"
    return [f"SELECT count(*) AS n FROM {r}", f"SELECT * FROM {r} LIMIT 20", last]


def marker(store: ResultStore, rid: str) -> dict:
    """What stands in for a large result: columns, first and last rows, some group values, ready queries."""
    info, df = store.info(rid), store.read(rid)
    flat = [c for c, k in df.dtypes if not k.startswith(("map", "array", "struct"))]
    if info.time:
        first = ordered(df.select(*flat), info.time).limit(PREVIEW).collect()
        last = ordered(df.select(*flat), (info.time, "desc")).limit(PREVIEW).collect()[::-1]
    else:
        first, last = df.select(*flat).limit(PREVIEW).collect(), []
    groups, n = [], None
    if info.group:
        n = df.agg(F.countDistinct(info.group)).first()[0]
        groups = [r[0] for r in df.select(info.group).filter(F.col(info.group).isNotNull()).distinct().orderBy(info.group).limit(GROUPS).collect()]
    return {
        "result_id": rid, "rows": info.rows, "columns": [asdict(c) for c in info.columns], "first": [r.asDict() for r in first],
        "last": [r.asDict() for r in last], "group_values": groups, "group_count": n, "queries": ready_queries(info), "truncated": info.truncated,
    }


def estimate_tokens(text: str) -> int:
    return -(-len(text) // 4)


def json_ready(df: DataFrame) -> DataFrame:
    """Rows as JSON text: instants in ISO-8601 with Z, decimals as text, NaN and infinities null, bytes in hex."""
    cols = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        elif kind == "decimal":
            c = c.cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        elif kind == "binary":
            c = F.lower(F.hex(c))
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def finalize(store: ResultStore, df: DataFrame, tool: str, always: bool = False, **roles) -> dict:
    """A small answer inline, a large one stored: 200 rows and 6,000 estimated tokens at most are inline."""
    if not always:
        head = json_ready(df.limit(INLINE_ROWS + 1)).collect()
        if len(head) <= INLINE_ROWS and estimate_tokens("".join(r.json for r in head)) <= INLINE_TOKENS:
            return {"rows": [json.loads(r.json) for r in head]}
    return marker(store, store.put(df, tool, **roles).result_id)


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get _1, _2, ... whatever their case."""
    out, seen = [], set()
    for n in names:
        k, new = 0, n
        while new.lower() in seen:
            k += 1
            new = f"{n}_{k}"
        seen.add(new.lower())
        out.append(new)
    return out


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, and text that a spreadsheet would run as a formula led by a quote."""
    cols = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("array", "map", "struct"):
            c = F.to_json(c)
        elif kind == "binary":
            c = F.lower(F.hex(c))
        if kind in ("string", "array", "map", "struct"):
            c = F.when(c.rlike(r"^[\t\r ]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def export(store: ResultStore, rid: str, path: str, kind: str = "parquet", overwrite: bool = False) -> str:
    """Write a result as CSV or Parquet below a folder that exists."""
    if kind not in ("csv", "parquet"):
        raise Refusal("invalid_arguments", "Formats are csv and parquet.")
    parent = path.rstrip("/").rpartition("/")[0]
    fs, p = store._fs(path)
    if not fs.exists(store._fs(parent)[1]):
        raise Refusal("export_dir_missing", f"There is no folder {parent}.")
    if fs.exists(p) and not overwrite:
        raise Refusal("export_exists", f"{path} exists.", "Pass overwrite.")
    df = store.read(rid)
    writer = (csv_ready(df) if kind == "csv" else df).write.mode("overwrite" if overwrite else "errorifexists")
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.option("compression", "zstd").parquet(path)
    return path


def sampled(store: ResultStore, rid: str, n: int = 10, method: str = "first", columns: list[str] | None = None) -> DataFrame:
    """n rows (50 at most): the first or last by the result's time (nulls last; stored order without a time), or a seeded
    sample that is the same on every run."""
    if not 1 <= n <= 50 or method not in ("first", "last", "random"):
        raise Refusal("invalid_arguments", "A sample has 1 to 50 rows, by first, last or random.")
    info, df = store.info(rid), store.read(rid)
    if method == "random":
        flat = [c for c, k in df.dtypes if not k.startswith("map")]
        out = df.orderBy(F.xxhash64(F.lit(42), *(F.col(f"`{c}`") for c in flat))).limit(n)
    elif info.time is None:
        out = df.limit(n) if method == "first" else df.offset(max(0, info.rows - n))
    else:
        out = ordered(df, (info.time, "asc" if method == "first" else "desc")).limit(n)
        out = ordered(out, info.time)
    unknown = [c for c in columns or () if c not in df.columns]
    if unknown:
        raise Refusal("unknown_column", f"'{rid}' has no column '{unknown[0]}'.")
    return out.select(*(f"`{c}`" for c in columns)) if columns else out
