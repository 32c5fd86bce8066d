"""Rules of the series operators that the catalog's data don't reach."""

from __future__ import annotations

import math
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vantidal.errors import Refusal
from vantidal.functions.timeframes import check_target, default_periods_per_year, duration_micros, nests, span_end, time_bucket
from vantidal.operators import analytics as an
from vantidal.operators.asof import Clock, align, asof_join
from vantidal.operators.pit import Known, RowsOf, bucketed, dated_as, of_query
from vantidal.operators.points import Series, check_unique_times
from vantidal.operators.relational import column_summary, sample_rows, with_ties
from vantidal.operators.vintages import latest_versions, read_vintages

DAY = datetime(2026, 3, 2, tzinfo=UTC)


def at(n, hours=0):
    return (DAY + timedelta(days=n, hours=hours)).replace(tzinfo=None)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def prices(spark, values, s="A"):
    return frame(spark, [(s, at(i), float(v)) for i, v in enumerate(values)], "s string, t timestamp, v double")


def test_skips_are_counted_and_left_out(spark):
    rows = [("A", at(0), 1.0), ("A", None, 2.0), ("A", at(1), None), ("A", at(2), math.nan), ("A", at(3), math.inf), ("A", at(4), 0.0), (None, at(5), 2.0), ("A", at(6), 3.0)]
    inp = Series(frame(spark, rows, "s string, t timestamp, v double"), "t", "s", "v")
    assert inp.points(positive=True).count() == 2
    assert inp.skipped(positive=True) == {"no_time": 1, "no_value": 1, "non_finite": 2, "no_series": 1, "not_positive": 1}
    assert [r.ret for r in an.returns(inp).collect()] == [2.0]


def test_refusals(spark):
    df = prices(spark, [1.0, 2.0])
    for code, f in {
        "unknown_column": lambda: Series(df, "x"), "not_numeric": lambda: Series(df, "t", None, "s").value_column(),
        "duplicate_timestamps": lambda: check_unique_times(Series(df.union(df), "t", "s", "v").points()),
        "no_series_column": lambda: an.correlation(Series(df, "t", None, "v")), "too_few_series": lambda: an.correlation(Series(df, "t", "s", "v")),
        "unknown_series": lambda: an.split_benchmark(Series(df, "t", "s", "v"), "Z"), "invalid_arguments": lambda: an.volatility(Series(df, "t", "s", "v"), 1, periods=252),
        "timeframe_not_coarser": lambda: check_target("1d", "1h"), "timeframe_not_nested": lambda: check_target("1w", "1mo"),
        "invalid_tolerance": lambda: duration_micros("P1M"), "periods_per_year_required": lambda: an.volatility(Series(df, "t", "s", "v"), "all"),
        "no_value_columns": lambda: an.resample(df.select("s", "t"), "1w", series="s"),
        "mixed_timeframes": lambda: an.resample_bars(df.withColumn("timeframe", F.when(F.col("v") > 1, "1d").otherwise("1h")), "1w", "t", "s"),
    }.items():
        with pytest.raises(Refusal) as e:
            f()
        assert e.value.code == code


def test_timeframes():
    assert nests("5min", "1h") and not nests("7min", "1h") and nests("4h", "1d") and not nests("7h", "1d")
    assert nests("1d", "1w") and not nests("1h", "45min") and nests("1mo", "3mo") and not nests("2mo", "3mo") and not nests("1w", "1mo")
    assert duration_micros("P1DT2H0.5S") == 93_600_500_000 and duration_micros("PT0S") == 0
    assert default_periods_per_year("1d") == 252 and default_periods_per_year("1h") == 1638 and default_periods_per_year("4h") is None
    assert default_periods_per_year("5min") == 19656 and default_periods_per_year("1h", every_day=True) == 8760 and default_periods_per_year("30min", extended=True) == 8064


def test_buckets_floor_before_the_origin(spark):
    df = frame(spark, [("1970-01-01 00:30:00",), ("1999-12-31 23:59:59",), ("2026-10-04 10:00:00",)], "x string").select(F.col("x").cast("timestamp").alias("x"))
    got = [tuple(str(v) for v in r) for r in df.orderBy("x").select(time_bucket("1w", F.col("x")), time_bucket("5h", F.col("x")), time_bucket("3mo", F.col("x"))).collect()]
    assert got == [
        ("1969-12-29 00:00:00", "1969-12-31 20:00:00", "1970-01-01 00:00:00"), ("1999-12-27 00:00:00", "1999-12-31 22:00:00", "1999-10-01 00:00:00"),
        ("2026-09-28 00:00:00", "2026-10-04 06:00:00", "2026-10-01 00:00:00"),
    ]


def test_bar_ends_follow_the_calendar_of_their_zone(spark):
    rows = [("2026-03-06 05:00:00", "1w"), ("2026-03-06 00:00:00", "1w"), ("2026-03-06 10:00:00", "1d"), ("2026-03-06 10:00:00", "15min"), ("2026-01-01 05:00:00", "3mo"), ("2026-03-06 00:00:00", "x")]
    df = frame(spark, rows, "t string, s string").select(F.col("t").cast("timestamp").alias("t"), "s")
    got = [str(r[0]) for r in df.select(span_end(F.col("t"), F.col("s"))).collect()]
    # New York's clocks change on 2026-03-08: a week from its midnight is an hour shorter in UTC.
    assert got == ["2026-03-13 04:00:00", "2026-03-13 00:00:00", "2026-03-07 10:00:00", "2026-03-06 10:15:00", "2026-04-01 04:00:00", "None"]


def test_drawdown_cases(spark):
    df = prices(spark, [10, 8, 10, 5, 7.5, 5], "A").union(prices(spark, [1, 2, 3], "B")).union(prices(spark, [4], "C"))
    got = {r.series: r for r in an.drawdown_max(Series(df, "t", "s", "v")).collect()}
    assert set(got) == {"A", "B"}
    a = got["A"]
    assert (a.max_drawdown, a.peak_t, a.trough_t, a.recovery_t, a.absent, a.decline_days) == (-0.5, at(2), at(3), None, "not_recovered", 1.0)
    assert got["B"].max_drawdown == 0 and got["B"].absent == "not_applicable"


def test_beta_reasons(spark):
    bench = prices(spark, [100 + i % 3 for i in range(30)], "X")
    same = prices(spark, [50 + i % 3 / 2 for i in range(30)], "A")
    few, none = prices(spark, [1.0, 2.0], "B"), frame(spark, [("C", at(99), 1.0)], "s string, t timestamp, v double")
    flat = prices(spark, [5.0] * 30, "F")
    inp = Series(bench.union(same).union(few).union(none), "t", "s", "v")
    got = {r.series: r for r in an.beta(*an.split_benchmark(inp, "X")).collect()}
    assert math.isclose(got["A"].beta, 1.0) and math.isclose(got["A"].r_squared, 1.0)
    assert (got["B"].absent, got["B"].beta, got["C"].absent) == ("insufficient_data", None, "no_data")
    against_flat = an.beta(*an.split_benchmark(Series(flat.union(same), "t", "s", "v"), "F")).first()
    assert against_flat.beta is None and against_flat.absent == "not_applicable"


def test_volatility_counts_periods(spark):
    df = prices(spark, [100 + (i * 7 % 5) for i in range(40)]).withColumn("timeframe", F.lit("1d"))
    out = an.volatility(Series(df, "t", "s", "v"), 5)
    assert out.count() == 35
    alone = an.volatility(Series(df.drop("timeframe"), "t", "s", "v"), "all").first()
    assert alone.n_obs == 39
    pair = an.periods_per_year(Series(df, "t", "s", "v"), an.returns(Series(df.withColumn("s", F.lit("BTC/USD")), "t", "s", "v")))
    assert pair == 365


def test_vwap_and_trade_count(spark):
    rows = [("A", at(0), 1.0, 2.0, 0.5, 1.5, 10.0, 5, 1.2), ("A", at(1), 1.5, 3.0, 1.0, 2.0, 30.0, None, 1.8), ("B", at(0), 1.0, 1.0, 1.0, 1.0, 5.0, 1, None)]
    df = frame(spark, rows, "ticker string, t timestamp, open double, high double, low double, close double, volume double, trade_count long, vwap double")
    got = {r.ticker: r for r in an.resample_bars(df, "1w").collect()}
    assert (got["A"].open, got["A"].close, got["A"].volume, got["A"].trade_count) == (1.0, 2.0, 40.0, None)
    assert math.isclose(got["A"].vwap, (12 + 54) / 40) and got["B"].vwap is None


def test_resample_keeps_last_row_and_latest_clock(spark):
    rows = [("A", at(0), 1.0, at(9), "x"), ("A", at(1), math.nan, at(3), "y"), ("A", at(8), None, None, "z")]
    df = frame(spark, rows, "s string, t timestamp, v double, knowledge_time timestamp, tag string")
    got = sorted(an.resample(df, "1w", "sum", series="s").collect(), key=lambda r: r.t)
    assert (got[0].v, got[0].knowledge_time, got[0].tag) == (1.0, at(9), "y") and (got[1].v, got[1].tag) == (None, "z")


def test_asof_ties_nulls_and_tolerance(spark):
    left = frame(spark, [(1, "A", at(2)), (2, "A", None), (3, None, at(2)), (4, "B", at(2)), (5, "A", at(0))], "id int, k string, t timestamp")
    right = frame(spark, [("A", at(1), 10.0), ("A", at(2), 20.0), ("A", at(2), 21.0), (None, at(1), 9.0), ("A", None, 8.0)], "k string, seen timestamp, v double")
    got = {r.id: r for r in asof_join(left, right, "t", "seen", [("k", "k")]).collect()}
    assert {i: r.v for i, r in got.items()} == {1: 21.0, 2: None, 3: None, 4: None, 5: None} and len(got) == 5
    assert {r.id: r.v for r in asof_join(left, right, "t", "seen", [("k", "k")], "forward").collect()}[5] == 10.0
    late = left.withColumn("t", F.col("t") + F.expr("INTERVAL 1 HOUR"))
    assert {r.id: r.v for r in asof_join(late, right, "t", "seen", [("k", "k")], tolerance="PT0S").collect()}[1] is None
    with pytest.raises(Refusal) as e:
        asof_join(left.withColumn("v_right", F.lit(1)).withColumn("v", F.lit(1)), right, "t", "seen", [("k", "k")])
    assert e.value.code == "column_collision"


def test_align_never_looks_ahead(spark):
    left = frame(spark, [(i, at(i)) for i in range(1, 9)], "id int, t timestamp")
    right = frame(spark, [(at(0), at(2), 1.0), (at(1), at(4), 2.0), (at(0), at(5), 1.5), (at(2), None, 9.0)], "day timestamp, knowledge_time timestamp, v double")
    clock = Clock(column="knowledge_time")
    got = {r.id: r.v for r in align(left, right, "t", "day", right_columns=["v"], clock=clock).df.collect()}
    assert got == {1: None, 2: 1.0, 3: 1.0, 4: 2.0, 5: 2.0, 6: 2.0, 7: 2.0, 8: 2.0}  # the late revision of day 0 displaces nothing
    by_time = align(left, right, "t", "day", right_columns=["v"], match_on="time", clock=clock)
    assert by_time.look_ahead("t") == 1 and not by_time.point_in_time
    bars = frame(spark, [("1d", at(0), 5.0), ("1d", at(1), 6.0)], "timeframe string, day timestamp, v double")
    got = {r.id: r.v for r in align(left, bars, "t", "day", right_columns=["v"], clock=Clock(span="timeframe", lag_seconds=3600)).df.collect()}
    assert got[1] is None and got[2] == 5.0 and got[3] == 6.0
    with pytest.raises(Refusal) as e:
        align(left, right, "t", "day", clock=Clock(shown=False))
    assert e.value.code == "not_point_in_time"


def test_vintages(spark):
    rows = [("a", at(0), at(1), 1.0), ("a", at(0), at(3), 2.0), ("a", at(0), None, 3.0), ("b", at(0), None, 4.0)]
    df = frame(spark, rows, "k string, t timestamp, knowledge_time timestamp, v double")
    assert {r.k: r.v for r in latest_versions(df, ["k"]).collect()} == {"a": 2.0, "b": 4.0}
    assert [(r.k, r.v) for r in read_vintages(df, ["k"], as_of=str(at(2))).collect()] == [("a", 1.0)]
    assert read_vintages(df, ["k"], vintages="all", k=["a"]).count() == 3


def test_rules_follow_rows(spark):
    bars = prices(spark, [1.0, 2.0, 3.0]).withColumn("timeframe", F.lit("1d"))
    rule = RowsOf("Bar", span="timeframe")
    known = Known(bars, "t", rule)
    assert bucketed([known], "1w").span == "1w" and bucketed([known], "1w").lag_seconds == 0
    assert dated_as([known]).span == "timeframe"
    assert not dated_as([Known(bars, "t", RowsOf(clock="t"))]).shown
    bars.createOrReplaceTempView("bars_of_rules")
    inputs = {"bars_of_rules": known}
    kept, _ = of_query(spark.sql("SELECT t, v, timeframe FROM bars_of_rules WHERE v > 1"), inputs)
    assert kept.shown and kept.span == "timeframe"
    for sql in (
        "SELECT t, timeframe, lag(v) OVER (ORDER BY t) AS v FROM bars_of_rules", "SELECT v FROM bars_of_rules", "SELECT t, timeframe, max(v) AS v FROM bars_of_rules GROUP BY ALL",
        "SELECT t, timeframe, v FROM bars_of_rules WHERE v > (SELECT avg(v) FROM bars_of_rules)",
    ):
        rule_, found = of_query(spark.sql(sql), inputs)
        assert not rule_.shown, sql


def test_relational_helpers(spark):
    df = frame(spark, [(i, i // 3) for i in range(20)], "k int, g int")
    assert with_ties(df, 4, ("g", "asc")).count() == 6 and with_ties(df, 50, ("g", "asc")).count() == 20
    assert sorted(r.k for r in sample_rows(df, 5, "k").collect()) == sorted(r.k for r in sample_rows(df.repartition(7), 5, "k").collect())
    got = {r["column"]: r for r in column_summary(df.withColumn("m", F.create_map(F.lit("a"), "g"))).collect()}
    assert got["k"].greatest == "19" and got["m"].least is None
