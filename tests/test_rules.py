"""Windows of requests, tools, long series, locks and answers, where SQL has nothing to compare with."""

from __future__ import annotations

import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from vantidal.errors import Refusal
from vantidal.operators import analytics as an
from vantidal.operators.asof import asof_join
from vantidal.operators.points import Series
from vantidal.sources import windows
from vantidal.sources.paged import Page, fetch_keys
from vantidal.sources.tools import TOOLS, open_tool, parse, read_tool
from vantidal.store.answers import clocked_ancestor, envelope, riskiest
from vantidal.store.results import ResultStore, sampled

NOW = datetime(2026, 3, 10, 15, 0, tzinfo=UTC)


@pytest.mark.parametrize(
    "arguments",
    [{"start": "2026-03-09", "lookback": "P1D"}, {"start": "2026-03-11"}, {"start": "2026-03-09", "end": "2026-03-08T00:00:00Z"}, {"start": "yesterday"}, {"lookback": "P1M"}, {"lookback": "P99999999D"}],
)
def test_windows_that_are_refused(arguments):
    with pytest.raises(Refusal):
        windows.resolve(NOW, **arguments)


def test_windows():
    w = windows.resolve(NOW, end="2026-03-09", lookback="P1D", zone="America/New_York")
    assert w.end == datetime(2026, 3, 10, 3, 59, 59, 999999, tzinfo=UTC) and not w.open_end and len(w.notes) == 1
    w = windows.resolve(NOW, default="PT20M", lag="PT15M")
    assert (w.start.hour, w.start.minute, w.end.minute) == (14, 25, 45) and w.open_end
    assert windows.resolve(NOW, lookback="P2D", timeframe="1w").start == datetime(2026, 3, 8, tzinfo=UTC)
    assert windows.resolve(NOW, start="2026-03-01", end="2027-01-01").end == NOW


def test_bars_at_the_newest_edge_are_current(spark):
    bars = spark.createDataFrame([("A", "2026-03-09", 1.0), ("A", "2026-03-10", 2.0)], "ticker string, t string, close double").withColumn("t", F.col("t").cast("timestamp"))
    got = windows.cap_last_bars(bars, windows.resolve(NOW, start="2026-03-01"), "1d", zone="UTC")
    assert got.bars.count() == 2 and [(r.ticker, r.edge) for r in got.touched.collect()] == [("A", "current")]
    past = windows.resolve(NOW, start="2026-03-01", end="2026-03-09T12:00:00Z")
    left = windows.cap_last_bars(bars.filter("close = 1"), past, "1d", zone="UTC")
    assert left.bars.count() == 0 and left.touched.first().edge == "left out"
    quiet = windows.cap_last_bars(bars.filter("close = 1"), past, "1d", bars.limit(0), zone="UTC")
    assert quiet.bars.count() == 1


def test_tools(spark, tmp_path):
    assert len(TOOLS) > 50 and parse("x | a,b | t | -t,a | p | .").spec.order == (("t", "desc"), ("a", "asc"))
    rows = [("Q", 2, "2026-01-01", "2026-01-02", 1.0), ("Q", 2, "2026-01-01", "2026-02-02", 3.0), ("R", 1, "2026-01-05", "2026-01-06", 2.0)]
    df = spark.createDataFrame(rows, "tenor string, n int, date string, knowledge_time string, rate double").withColumns({c: F.col(c).cast("timestamp") for c in ("date", "knowledge_time")})
    df.write.parquet(f"{tmp_path}/treasury_yield_curve.parquet")
    assert [r.rate for r in open_tool(spark, str(tmp_path), "treasury_yield_curve").rows.collect()] == [0.03, 0.02]
    assert [r.rate for r in read_tool(df, "treasury_yield_curve", as_of="2026-01-31", tenor=["Q"]).rows.collect()] == [0.01]
    for bad in ({"name": "nothing"}, {"name": "treasury_yield_curve", "colour": "red"}):
        with pytest.raises(Refusal):
            read_tool(df, **bad)


def ticks(spark, n, twice=False):
    df = spark.range(n).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 37).alias("t"), (F.lit(100.0) + F.pmod(F.col("id") * 7919, F.lit(1013))).alias("v"))
    return df.union(df.limit(1)) if twice else df


def test_long_series_are_cut_by_themselves(spark, monkeypatch):
    """A table without a series column gives the same rows from many pieces."""
    from vantidal.operators import asof, points

    whole = lambda f: sorted(f(Series(ticks(spark, 5000), "t", None, "v")).collect(), key=str)
    calls = [an.returns, an.drawdown_series, lambda s: an.volatility(s, 20, periods=252)]
    want = [whole(f) for f in calls]
    left = ticks(spark, 5000).select(F.col("t").alias("lt"), F.col("v").alias("x")).filter("x < 400")
    right = ticks(spark, 5000).filter("v > 900")
    matched = [sorted(asof_join(left, right, "lt", "t", direction=d).collect(), key=str) for d in ("backward", "forward")]
    monkeypatch.setattr(points, "LONG", 300)
    monkeypatch.setattr(asof, "LONG", 300)
    assert [whole(f) for f in calls] == want
    assert [sorted(asof_join(left, right, "lt", "t", direction=d).collect(), key=str) for d in ("backward", "forward")] == matched
    plan = an.returns(Series(ticks(spark, 5000), "t", None, "v"))._jdf.queryExecution().executedPlan().toString()
    assert "p#" in plan


def test_rolling_windows_see_over_block_edges(spark):
    from vantidal.operators.points import in_blocks

    rets = ticks(spark, 400).select(F.lit("a").alias("series"), "t", F.col("v").alias("ret"))
    rows = in_blocks(rets, "series", "t", "1h", 30)
    assert rows.filter("own").count() == 400


@pytest.mark.parametrize("spread", [None, "1h"])
def test_repeated_times_fail_where_neighbours_meet(spark, spread):
    s = Series(ticks(spark, 50, twice=True), "t", None, "v", spread=spread)
    for f in (an.returns, an.drawdown_series, lambda x: an.volatility(x, 5, periods=252)):
        with pytest.raises(Exception, match="duplicate_timestamps"):
            f(s).collect()


def test_truncated_keys_are_told(spark):
    got = fetch_keys(spark, ["a", "b"], lambda key, token: Page([{"k": key}], f"{token}x" if key == "a" else None), "k string", per_minute=6e5, tasks=1).collect()
    assert {(r.k, r.truncated) for r in got} == {("a", True), ("b", False)}


def test_locks_and_orphans(spark, tmp_path, monkeypatch):
    from vantidal.store import results

    store = ResultStore(spark, "locks", str(tmp_path))
    df = spark.range(3).coalesce(1).withColumn("s", F.lit("x"))
    rid = store.put(df, "x").result_id
    with store.locked(), pytest.raises(Refusal) as e, store.locked(wait=0.1):
        pass
    assert e.value.code == "store_busy"
    monkeypatch.setattr(results, "LOCK_SECONDS", -1)
    store._write_text(f"{store.root}/.lock", "")  # a lock that its owner left behind
    with store.locked(wait=0.5):
        pass
    df.write.parquet(f"{store.root}/.tmp-r_0000000000/data")
    store.evict()
    assert len([f for f in (tmp_path / "results" / "locks").iterdir() if f.name.startswith(".tmp")]) == 1
    monkeypatch.setattr(results, "ORPHAN_SECONDS", -1)
    store.evict()
    assert not [f for f in (tmp_path / "results" / "locks").iterdir() if f.name.startswith(".tmp")] and store.live() == [rid]
    assert sampled(store, rid, 2, "random").count() == 2 and [r.id for r in sampled(store, rid, 2, "last").collect()] == [1, 2]
    for bad in ({"n": 51}, {"method": "some"}, {"columns": ["nope"]}):
        with pytest.raises(Refusal):
            sampled(store, rid, **bad)


def test_queries_have_a_time_limit(spark, tmp_path):
    store = ResultStore(spark, "slow", str(tmp_path))
    rid = store.put(spark.range(2000), "x").result_id
    began = time.time()
    with pytest.raises(Refusal) as e:
        store.query(f"SELECT count(*) AS n FROM {rid} a, {rid} b, {rid} c WHERE a.id + b.id * c.id % 7 > 3", seconds=1)
    assert e.value.code == "sql_timeout" and time.time() - began < 60
    for bad in ({"most": 0}, {"most": 500}, {"seconds": 500}):
        with pytest.raises(Refusal):
            store.query(f"SELECT * FROM {rid}", **bad)


def test_answers(spark, tmp_path):
    assert envelope("t", "none", [1])["data"] == [1] and envelope("t", "none", error=Refusal("sql_table", "x"))["error"]["code"] == "sql_table"
    assert riskiest("none", "third_party_text", "vendor_text") == "third_party_text" and riskiest() == "none"
    store = ResultStore(spark, "family", str(tmp_path))
    df = spark.range(1).select("id", F.current_timestamp().alias("known", metadata={"role": "available"}))
    a = store.put(df, "a").result_id
    b = store.put(df.select("id"), "b", parents=[a]).result_id
    c = store.put(df.select("id"), "c", parents=[b, "r_0000000000"]).result_id
    assert clocked_ancestor(store, c) == (a, "known") and clocked_ancestor(store, a) is None
    with pytest.raises(Refusal):
        envelope("t", "terrible")


def test_refresh_by_age(spark, tmp_path):
    from datetime import timedelta

    from vantidal.sources.refresh import Slice, refresh

    part, hour, calls = Slice(spark, str(tmp_path), "rates"), timedelta(hours=1), []

    def fetch():
        calls.append(1)
        return spark.range(len(calls), len(calls) + 1)

    with pytest.raises(Refusal):
        refresh(part, fetch, hour, "local")
    assert refresh(part, fetch, hour, now=NOW)[1] and not refresh(part, fetch, hour, now=NOW + hour / 2)[1]
    rows, fetched = refresh(part, fetch, hour, now=NOW + 2 * hour)
    assert fetched and sorted(r.id for r in rows.collect()) == [1, 2] and not refresh(part, fetch, hour, "local", NOW + 9 * hour)[1]
    assert refresh(part, fetch, hour, "always", NOW)[1] and len(calls) == 3
    with pytest.raises(Refusal):
        refresh(part, fetch, hour, "sometimes")


def test_models_of_a_folder(tmp_path):
    from vantidal.schema.models import load_models

    (tmp_path / "a.json").write_text('{"title": "A", "type": "object", "properties": {"x": {"type": "integer"}, "k": {"type": "string", "format": "date-time", "x-role": "available"}}, "required": ["x"], "x-time": "k"}')
    got = load_models(str(tmp_path))
    assert list(got) == ["A"] and got["A"].available == "k" and got["A"].time == "k"
    (tmp_path / "b.json").write_text("[]")
    with pytest.raises((Refusal, AttributeError)):
        load_models(str(tmp_path))
