"""Results: put, read, query, markers, export, eviction; models and their absence rule."""

from __future__ import annotations

import json
import math
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vantidal.errors import Refusal
from vantidal.schema.models import MODELS, conform, from_json_schema, unexplained
from vantidal.store.results import ResultStore, export, finalize, json_ready, marker, ready_queries

DAY = datetime(2026, 3, 2)


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, "session-1", str(tmp_path))


def bars(spark, n=30):
    return spark.range(n).select(
        F.concat(F.lit("T"), (F.col("id") % 3).cast("string")).alias("ticker"), F.timestamp_seconds(F.lit(1772409600) + F.col("id") * 3600).alias("t"),
        (F.col("id") * 1.5).alias("close").alias("close", metadata={"unit": "price"}),
    )


def test_put_read_query(spark, store):
    info = store.put(bars(spark), "bars", time="t", group="ticker", model="Bar")
    assert info.rows == 30 and store.live() == [info.result_id] and store.info(info.result_id) == info
    assert {c.name: c.unit for c in info.columns}["close"] == "price" and info.columns[2].greatest == "43.5"
    assert store.read(info.result_id, ["close"], 4).count() == 4
    got = store.query(f"SELECT ticker, max(close) AS m FROM {info.result_id} GROUP BY ALL ORDER BY ticker").collect()
    assert [r.m for r in got] == [40.5, 42.0, 43.5]
    for sql in ready_queries(info):
        assert store.query(sql).count() > 0
    seen = marker(store, info.result_id)
    assert seen["rows"] == 30 and len(seen["first"]) == len(seen["last"]) == 3 and seen["group_values"] == ["T0", "T1", "T2"] and seen["group_count"] == 3
    with pytest.raises(Refusal):
        store.read("r_0123456789")
    with pytest.raises(Refusal):
        store.query("SELECT * FROM r_0123456789")
    assert ResultStore(spark, "session-2", store.root.rsplit("/results", 1)[0]).live() == []
    assert store.drop(info.result_id) == 1 and store.live() == []


def test_ready_queries_without_time(spark, store):
    text = store.put(bars(spark).select("ticker", "close"), "x")
    numbers = store.put(bars(spark).select("close"), "x")
    for info in (text, numbers, store.put(bars(spark), "x", time="t")):
        assert len(ready_queries(info)) == 3
        for sql in ready_queries(info):
            assert store.query(sql).count() > 0


def test_truncation_passes_on_and_size_evicts(spark, store):
    first = store.put(bars(spark), "x", truncated=True)
    second = store.put(bars(spark, 5), "y", parents=[first.result_id])
    assert second.truncated and store.usage()["results"] == 2
    store.most = second.size + first.size - 1
    assert store.evict() == [first.result_id]
    store.ttl = store.ttl * 0
    assert store.evict() == [second.result_id]


def test_inline_or_stored(spark, store):
    assert len(finalize(store, bars(spark, 5), "x")["rows"]) == 5
    assert finalize(store, bars(spark, 500), "x", time="t")["rows"] == 500
    row = spark.createDataFrame([(math.nan, Decimal("1.5"), DAY, bytearray(b"\x01\xff"), None)], "a double, b decimal(5,2), c timestamp, d binary, e string")
    assert json.loads(json_ready(row).first().json) == {"a": None, "b": "1.50", "c": "2026-03-02T00:00:00.000000Z", "d": "01ff", "e": None}


def test_export(spark, store, tmp_path):
    df = spark.createDataFrame([("=1+1", [1, 2]), ("ok", None)], "x string, l array<int>")
    rid = store.put(df, "x").result_id
    path = export(store, rid, str(tmp_path / "out.csv"), "csv")
    assert sorted((r.x, r.l) for r in spark.read.option("header", True).csv(path).collect()) == [("'=1+1", "[1,2]"), ("ok", None)]
    with pytest.raises(Refusal) as e:
        export(store, rid, path, "csv")
    assert e.value.code == "export_exists"
    with pytest.raises(Refusal) as e:
        export(store, rid, str(tmp_path / "none" / "x"))
    assert e.value.code == "export_dir_missing"
    assert spark.read.parquet(export(store, rid, str(tmp_path / "out.parquet"))).count() == 2


def test_conform_explains_nulls_and_keeps_decimals_exact(spark):
    df = spark.createDataFrame([("paper", "1d", DAY, "12345678901234.123456789012", None)], "environment string, timeframe string, t timestamp, equity string, profit_loss string")
    out = conform(df, MODELS["PortfolioPoint"], {"profit_loss": "not_reported", "base_value": "not_available"})
    row = out.first()
    assert row.equity == Decimal("12345678901234.123456789012") and row.absent["base_value"] == "not_available"
    assert unexplained(out, MODELS["PortfolioPoint"]).count() == 0
    assert unexplained(out.withColumn("absent", F.lit(None).cast("map<string,string>")), MODELS["PortfolioPoint"]).first().unexplained
    assert out.schema["equity"].metadata == {"unit": "USD"}
    with pytest.raises(Exception, match="unrepresentable_decimal"):
        conform(df.withColumn("equity", F.lit("0.1234567890123")), MODELS["PortfolioPoint"]).collect()


def test_models_from_json_schema():
    text = json.dumps({
        "title": "Point", "type": "object", "x-time": "t", "x-group": "id", "x-values": ["v"], "required": ["id", "t"],
        "properties": {"id": {"type": "string"}, "t": {"type": "string", "format": "date-time"}, "v": {"anyOf": [{"type": "number"}, {"type": "null"}], "x-unit": "USD"},
                       "k": {"type": "string", "format": "date-time", "x-role": "available"}, "l": {"type": "array", "items": {"type": "integer"}}},
    })
    m = from_json_schema(text)
    assert m.schema.simpleString() == "struct<id:string,t:timestamp,v:double,k:timestamp,l:array<bigint>>" and m.available == "k" and m.units == {"v": "USD"}
    assert not m.schema["id"].nullable and m.schema["v"].nullable
