"""Spark rows against DuckDB rows, whatever their order."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (int, float, Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(plain(x) for x in v)
    return str(v)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def assert_same(df, con, sql: str) -> None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    assert len(got) == len(want)
    assert got == want
