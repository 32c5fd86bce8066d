"""The plans that Spark makes of the operators: what is pushed down, pruned and avoided; time limits; extensions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantidal import catalog
from vantidal.errors import Refusal
from vantidal.plans import guard
from vantidal.plans.extensions import Operator, Registry
from vantidal.session import forget, load, through_store


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["asof_backward", "asof_forward", "asof_tolerance", "align_available"])
def test_asof_joins_pair_nothing(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "Join" not in text and "Cartesian" not in text and "Window" in text


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_python_and_no_product(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "ArrowEvalPython" not in text and "MapIn" not in text and "BatchEvalPython" not in text
    if name not in ("join_grid", "correlation_returns", "correlation_levels", "sql_recursive"):
        assert "CartesianProduct" not in text


def test_filters_and_columns_reach_the_files(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    query = guard.run(spark, "SELECT o_orderkey FROM o WHERE o_totalprice > 1000 AND o_orderstatus = 'F'", {"o": o})
    (scan,) = [x for x in _leaves(query._jdf.queryExecution().executedPlan())]
    filters = scan.metadata().get("PushedFilters").get()
    assert "GreaterThan(o_totalprice,1000.0)" in filters and "EqualTo(o_orderstatus,F)" in filters and "o_orderpriority" not in scan.schema().simpleString()
    text = plan(catalog.QUERIES["vintages_as_of"](spark, sf))
    assert "props" not in text and "partial_max_by" in text


def _leaves(node):
    found = node.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def test_aggregates_are_combined_before_the_shuffle(spark, sf):
    for name in ("resample_daily_bars", "latest_row", "vintages_latest", "pricing_summary"):
        text = plan(catalog.QUERIES[name](spark, sf))
        assert "partial_" in text and text.count("Exchange") == 1


def test_top_rows_are_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["top_per_key"](spark, sf))


def test_time_limit(spark):
    slow = spark.range(0, 4 * 10**7, 1, 8).select(F.max(F.sha2(F.col("id").cast("string"), 512)))
    with pytest.raises(Refusal) as e:
        guard.rows_within(slow, 0.3)
    assert e.value.code == "sql_timeout"
    assert guard.rows_within(spark.range(3), 60) == [(0,), (1,), (2,)]


def test_stored_frames_are_forgotten(spark):
    df = through_store(spark.range(5), "x")
    assert df.count() == 5
    path = df._stored_at
    forget(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_extensions(spark, sf):
    r = Registry(off={"portfolio"})
    double = Operator("double", lambda df: df.select((F.col("id") * 2).alias("id")), T.StructType([T.StructField("id", T.LongType())]))
    wrong = Operator("wrong", lambda df: df, T.StructType([T.StructField("x", T.LongType())]))
    r.register([double, wrong, Operator("hidden", lambda df: df, capability="portfolio")])
    assert r.available() == ["double", "wrong"] and [x.id for x in r.call("double", spark.range(3)).collect()] == [0, 2, 4]
    for f in (lambda: r.call("hidden", spark.range(1)), lambda: r.call("wrong", spark.range(1)), lambda: r.register([double]), lambda: r.register([Operator("w", len, read_only=False)])):
        with pytest.raises(Refusal):
            f()
    assert load(spark, sf, "events").schema["ts"].dataType == T.TimestampType()
