"""Returns, volatility, correlation, resampling, drawdown and beta over time series.

All operators take tables of any size: the order within a series comes from window functions, so one
series is one window partition and series spread over the cluster; what is looked up for each series
(a trough, a benchmark) is joined, and adaptive execution broadcasts it where it is small. A series that is too long for
a task is cut by time (`Series.spread`; a table without a series column by itself): pieces are scanned apart, and what one
hands to the next comes from a table of a row a piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantidal.errors import Refusal
from vantidal.functions.numeric import finite, ratio, safe_corr
from vantidal.functions.timeframes import BAR_ZONE, check_target, default_periods_per_year, parts, seconds, time_bucket
from vantidal.operators.points import NUMERIC, Series, check_unique_times, in_blocks, once, piece, single_timeframe, spread_of, with_before
from vantidal.session import through_store

WINDOW_LEAST, WINDOW_MOST = 2, 2520
SERIES_MOST = 50
YEAR_SECONDS = 365.25 * 86_400


def _check_window(window: int) -> None:
    if not WINDOW_LEAST <= window <= WINDOW_MOST:
        raise Refusal("invalid_arguments", f"A window has {WINDOW_LEAST} to {WINDOW_MOST} returns.")


def _change(kind: str, v: Column, before: Column) -> Column:
    if kind not in ("simple", "log"):
        raise Refusal("invalid_arguments", f"'{kind}' is no kind of return.", "Use simple or log.")
    return F.log(v / before) if kind == "log" else v / before - 1


def sampled(points: DataFrame, period: str | None) -> DataFrame:
    """The last value of each bucket, dated at the bucket's start; the points themselves without a period."""
    if period is None:
        return points
    bucket = time_bucket(period, F.col("ts"))
    return points.groupBy("s", bucket.alias("b")).agg(F.max_by("v", "ts").alias("v")).withColumnRenamed("b", "ts").select("s", "ts", "v")


def returns(inp: Series, kind: str = "simple", period: str | None = None, check: bool = True) -> DataFrame:
    """series, t, ret, kind, period: changes between consecutive values (or buckets' last values)."""
    if period is not None and (tf := single_timeframe(inp.df)) and seconds(period) < seconds(tf):
        raise Refusal("mismatched_frequency", f"{period} is finer than the bars' {tf}.")
    points = inp.points(positive=True)
    if period is not None and check:
        check_unique_times(points, inp.label)  # a bucket's last value hides repeated times
    points = sampled(points, period)
    before = with_before(points, spread_of(inp, points), inp.label).filter("t0 IS NOT NULL")
    return before.select(
        F.col("s").alias("series"), F.col("ts").alias("t"), _change(kind, F.col("v"), F.col("v0")).alias("ret"),
        F.lit(kind).alias("kind"), F.lit(period).cast("string").alias("period"),
    )


# --- Volatility --------------------------------------------------------------------------------


def _median_count(counts: DataFrame) -> float:
    """The median of n, from how often each number occurs: a day's returns have few numbers."""
    rows = sorted((r.n, r.k) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect())
    total, seen, middle = sum(k for _, k in rows), 0, []
    for n, k in rows:
        middle += [n for place in ((total - 1) // 2, total // 2) if seen <= place < seen + k]
        seen += k
    return sum(middle) / 2


def observed_periods_per_year(rets: DataFrame, every_day: bool = False) -> float:
    """Counted from rows (series, t): the median day's returns times the days of a year, or the number a year
    over the time they span where they are more than a day apart."""
    w = Window.partitionBy("series").orderBy("t")
    gap = rets.select((F.unix_micros("t") - F.unix_micros(F.lag("t").over(w))).alias("gap")).filter("gap IS NOT NULL")
    row = gap.agg(F.percentile_approx("gap", 0.5).alias("gap"), F.count("*").alias("n")).first()
    if not row.n or row.n < 5:
        raise Refusal("periods_per_year_required", "There are too few returns to count them per year.", "Pass periods_per_year.")
    if row.gap / 1e6 <= 1.5 * 86_400:
        local = F.col("t") if every_day else F.from_utc_timestamp("t", BAR_ZONE)
        per_day = rets.groupBy("series", F.to_date(local).alias("d")).agg(F.count("*").alias("n"))
        return (365 if every_day else 252) * _median_count(per_day)
    spans = rets.groupBy("series").agg(
        (F.count("*") - 1).alias("k"), ((F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 1e6).alias("span")
    )
    row = spans.filter("k >= 1").agg(F.sum("k").alias("k"), F.sum("span").alias("span")).first()
    return float(max(1, round(row.k / row.span * YEAR_SECONDS)))


def periods_per_year(inp: Series, rets: DataFrame) -> float:
    """The default annualisation, by timeframe and market; a series named BASE/QUOTE trades every day."""
    tf = single_timeframe(inp.df)
    if "asset_class" in inp.df.columns:
        crypto = F.col("asset_class") == "crypto"
        row = inp.df.agg(F.coalesce(F.bool_or(crypto), F.lit(False)).alias("some"), F.coalesce(F.bool_or(~crypto), F.lit(False)).alias("others")).first()
        if row.some and row.others:
            raise Refusal("periods_per_year_required", "The table mixes crypto with assets that don't trade every day.", "Pass periods_per_year.")
        every_day = row.some
    else:
        every_day = bool(rets.agg(F.coalesce(F.bool_and(F.col("series").contains("/")), F.lit(False))).first()[0])
    if tf is None:
        return observed_periods_per_year(rets, every_day)
    w = Window.partitionBy("series").orderBy("t")
    gap = rets.select((F.unix_micros("t") - F.unix_micros(F.lag("t").over(w))).alias("gap")).filter("gap IS NOT NULL")
    row = gap.agg(F.percentile_approx("gap", 0.5).alias("gap"), F.count("*").alias("n")).first()
    if row.n >= 5 and row.gap >= 2e6 * seconds(tf):  # sampled, or with missing bars
        return observed_periods_per_year(rets, every_day)
    if (regular := default_periods_per_year(tf, every_day=every_day)) is None:
        raise Refusal("periods_per_year_required", f"{tf} bars have no default.", "Pass periods_per_year.")
    if parts(tf)[1] in ("min", "h") and not every_day:
        local = F.from_utc_timestamp("t", BAR_ZONE)
        opens = F.hour(local) * 60 + F.minute(local)
        if not rets.filter((opens >= 16 * 60) | (opens + seconds(tf) // 60 <= 9 * 60 + 30)).isEmpty():
            per_day = rets.groupBy("series", F.to_date(local).alias("d")).agg(F.count("*").alias("n"))
            counted = 252 * _median_count(per_day)
            return min(max(counted, regular), default_periods_per_year(tf, extended=True))
    return regular


def volatility(inp: Series, window: int | str = 21, return_kind: str = "log", periods: float | None = None, as_returns: bool = False) -> DataFrame:
    """series, t, start, volatility, n_obs: annualised sample deviation of the last `window` returns.

    Rows before a full window are left out. `window` "all" gives a row for each series at its last time.
    """
    points = inp.points(positive=not as_returns)
    spread = spread_of(inp, points)
    if as_returns:
        seen = with_before(points, spread, inp.label)
        rets = seen.select(F.col("s").alias("series"), F.col("ts").alias("t"), once(F.col("v"), F.col("ts"), F.col("t0"), inp.label).alias("ret"))
    else:
        rets = returns(inp, return_kind).select("series", "t", "ret")
    if periods is None:
        rets = through_store(rets, "returns")  # several passes tell the default
    ppy = periods if periods is not None else periods_per_year(inp, rets)
    scale = F.sqrt(F.lit(float(ppy)))
    if window == "all":
        out = rets.groupBy("series").agg(
            F.max("t").alias("t"), F.min("t").alias("start"), (F.stddev_samp("ret") * scale).alias("volatility"), F.count("*").alias("n_obs")
        )
        return out.filter("n_obs >= 2")
    _check_window(int(window))
    keys = ["series"]
    if spread is not None:
        rets, keys = in_blocks(rets, "series", "t", spread, int(window)), ["series", "block"]
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(1 - int(window), 0)
    out = rets.select(
        "series", "t", F.min("t").over(w).alias("start"), (F.stddev_samp("ret").over(w) * scale).alias("volatility"),
        F.count("ret").over(w).alias("n_obs"), *(["own"] if spread is not None else []),
    ).filter(F.col("n_obs") == int(window))
    return out.filter("own").drop("own") if spread is not None else out


# --- Correlation -------------------------------------------------------------------------------


def correlation(inp: Series, transform: str = "returns", min_overlap: int = 20, method: str = "pearson") -> DataFrame:
    """series_a, series_b, correlation, n_obs for every ordered pair of 2 to 50 series, the diagonal included.

    With `returns` each pair's returns run over the times that both have. Only pairs a <= b are computed;
    the others mirror them. Null below `min_overlap` or where a side is constant. Spearman ranks within a pair.
    """
    if transform not in ("returns", "levels") or method not in ("pearson", "spearman"):
        raise Refusal("invalid_arguments", "Transforms are returns and levels, methods pearson and spearman.")
    if inp.series is None:
        raise Refusal("no_series_column", "Correlation needs a series column.")
    points = inp.points(positive=transform == "returns")
    if transform == "levels":
        check_unique_times(points, inp.label)
    names = points.select("s").distinct()
    k = names.limit(SERIES_MOST + 1).count()
    if k > SERIES_MOST:
        raise Refusal("too_many_series", f"There are more than {SERIES_MOST} series.", "Keep fewer.")
    if k < 2:
        raise Refusal("too_few_series", "Correlation needs two series.")
    a, b = points.alias("a"), points.alias("b")
    both = a.join(b, (F.col("a.ts") == F.col("b.ts")) & (F.col("a.s") <= F.col("b.s"))).select(
        F.col("a.s").alias("x"), F.col("b.s").alias("y"), F.col("a.ts").alias("ts"), F.col("a.v").alias("v"), F.col("b.v").alias("u")
    )
    if transform == "returns":
        w = Window.partitionBy("x", "y").orderBy("ts")
        last = once(F.lag("v").over(w), F.col("ts"), F.lag("ts").over(w), inp.label)  # each series is paired with itself, too
        both = both.withColumn("v", F.col("v") / last - 1).withColumn("u", F.col("u") / F.lag("u").over(w) - 1)
        both = both.filter("v IS NOT NULL AND u IS NOT NULL")
    if method == "spearman":
        for c in ("v", "u"):
            rank = Window.partitionBy("x", "y").orderBy(c)
            same = Window.partitionBy("x", "y", c)
            both = both.withColumn(c, F.rank().over(rank) + (F.count("*").over(same) - 1) / 2.0)
    stats = both.groupBy("x", "y").agg(safe_corr(F.col("v"), F.col("u")).alias("c"), F.count("*").alias("n"))
    grid = names.select(F.col("s").alias("x")).join(names.select(F.col("s").alias("y")), F.col("x") <= F.col("y"))  # at most 50 x 50
    half = grid.join(stats, ["x", "y"], "left").select(
        "x", "y", F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("n") >= min_overlap, F.when((F.col("x") == F.col("y")) & F.col("c").isNotNull(), F.lit(1.0)).otherwise(F.col("c"))).alias("c"),
    )
    full = half.union(half.filter("x <> y").select(F.col("y"), F.col("x"), "n", "c"))
    return full.select(F.col("x").alias("series_a"), F.col("y").alias("series_b"), F.col("c").alias("correlation"), F.col("n").alias("n_obs"))


# --- Resampling --------------------------------------------------------------------------------


def resample_bars(bars: DataFrame, timeframe: str, time: str = "t", series: str | None = "ticker", order: str | None = None) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, summed volume; trade_count is null if any
    is missing; vwap weighs by volume over bars that have both. `order` breaks ties of time (a row number)."""
    check_target(single_timeframe(bars), timeframe)
    key = F.struct(F.col(time), F.col(order)) if order else F.struct(F.col(time))
    has = {c: c in bars.columns for c in ("volume", "trade_count", "vwap", "currency", "asset_class")}
    out = [
        F.min_by("open", key).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", key).alias("close"),
    ]
    if has["volume"]:
        out.append(F.sum("volume").alias("volume"))
    if has["trade_count"]:
        out.append(F.when(F.count("trade_count") == F.count("*"), F.sum("trade_count")).alias("trade_count"))
    if has["vwap"] and has["volume"]:
        counted = (F.col("volume") > 0) & F.col("vwap").isNotNull()
        whole = F.count(F.when((F.col("volume") > 0) & F.col("vwap").isNull(), 1)) == 0
        value = ratio(F.sum(F.when(counted, F.col("vwap") * F.col("volume"))), F.sum(F.when(counted, F.col("volume"))))
        out.append(F.when(whole, value).alias("vwap"))
    out += [F.max_by(F.struct(c), key)[c].alias(c) for c in ("currency", "asset_class") if has[c]]
    by = [*([F.col(series)] if series else []), time_bucket(timeframe, F.col(time)).alias("bucket")]
    made = bars.filter(F.col(time).isNotNull()).groupBy(*by).agg(F.lit(timeframe).alias("timeframe"), *out, F.count("*").alias("bars"))
    return made.withColumnRenamed("bucket", time)


def resample_any(df: DataFrame, timeframe: str, rule=None, agg: str = "last", time: str = "t", series: str | None = None, order: str | None = None) -> DataFrame:
    """Bars by the bar rules, also those that a query handed on (`rule` says what the rows are made of); other tables by `agg`."""
    from vantidal.operators.pit import passes_bars

    if passes_bars(df, rule):
        return resample_bars(df, timeframe, time, series, order)
    return resample(df, timeframe, agg, time, series, order=order)


#: How a value column is combined within a bucket.
COMBINE = ("last", "first", "mean", "sum", "min", "max")


def resample(df: DataFrame, timeframe: str, agg: str = "last", time: str = "t", series: str | None = None, values: list[str] | None = None,
             clocks: tuple[str, ...] = ("knowledge_time", "ingested_at"), order: str | None = None) -> DataFrame:
    """Any series by bucket: value columns by `agg`, clocks by their latest, other columns from the bucket's last row.

    Null and non-finite values are left out of `agg`; a bucket without values has null.
    """
    if agg not in COMBINE:
        raise Refusal("invalid_arguments", f"'{agg}' is none of {', '.join(COMBINE)}.")
    check_target(single_timeframe(df), timeframe)
    fixed = {time, series, order} | set(clocks)
    if values is None:
        values = [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in fixed]
    if not values:
        raise Refusal("no_value_columns", "There is no numeric column to combine.")
    key = F.struct(F.col(time), F.col(order)) if order else F.struct(F.col(time))

    def combined(c: str) -> Column:
        floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        x = F.when(finite(F.col(c)), F.col(c)) if floating else F.col(c)
        at = F.when(x.isNotNull(), key)
        return {
            "last": lambda: F.max_by(x, at), "first": lambda: F.min_by(x, at), "mean": lambda: F.avg(x.cast("double")),
            "sum": lambda: F.sum(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
        }[agg]().alias(c)

    others = [c for c in df.columns if c not in values and c not in fixed and c not in ("timeframe", "period")]
    by = [*([F.col(series)] if series else []), time_bucket(timeframe, F.col(time)).alias("__bucket")]
    aggs = [combined(c) for c in values] + [F.max(c).alias(c) for c in clocks if c in df.columns]
    if others:
        aggs.append(F.max_by(F.struct(*others), key).alias("__last"))
    out = df.filter(F.col(time).isNotNull()).groupBy(*by).agg(*aggs)
    cols = [*([F.col(series)] if series else []), F.col("__bucket").alias(time), F.lit(timeframe).alias("timeframe")]
    cols += [F.col(c) for c in values] + [F.col(c) for c in clocks if c in df.columns] + [F.col(f"__last.`{c}`").alias(c) for c in others]
    return out.select(*cols)


# --- Drawdown ----------------------------------------------------------------------------------


def drawdown_series(inp: Series) -> DataFrame:
    """series, t, value, peak, drawdown of every value of a series with two or more."""
    points = inp.points(positive=True)
    spread = spread_of(inp, points)
    if spread is None:
        every = Window.partitionBy("s")
        w = every.orderBy("ts")
        out = points.withColumn("pk", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("t0", F.lag("ts").over(w)).withColumn("n", F.count("*").over(every)).filter("n >= 2")
    else:  # the peak of the pieces before, and the series' number of rows, come from a row a piece
        cut = points.withColumn("p", piece(spread, F.col("ts")))
        tops = cut.groupBy("s", "p").agg(F.max("v").alias("top"), F.max("ts").alias("end"), F.count("*").alias("k"))
        order = Window.partitionBy("s").orderBy("p")
        tops = tops.select(
            "s", "p", F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("top"), F.lag("end").over(order).alias("end"),
            F.sum("k").over(Window.partitionBy("s")).alias("n"),
        )
        w = Window.partitionBy("s", "p").orderBy("ts")
        rows = cut.withColumn("own", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("t1", F.lag("ts").over(w))
        rows = rows.join(tops, ["s", "p"]).filter("n >= 2")
        out = rows.select("s", "ts", "v", F.greatest("own", "top").alias("pk"), F.coalesce("t1", "end").alias("t0"))
    return out.select(
        F.col("s").alias("series"), F.col("ts").alias("t"), once(F.col("v"), F.col("ts"), F.col("t0"), inp.label).alias("value"), F.col("pk").alias("peak"),
        (F.col("v") / F.col("pk") - 1).alias("drawdown"),
    )


def drawdown_max(inp: Series) -> DataFrame:
    """For each series: the deepest drawdown (the earliest of equal ones), its peak, trough and recovery, in days.

    One row for each series is joined back; the rows stay where the running peak put them.
    """
    dd = drawdown_series(inp)
    worst = dd.groupBy("series").agg(
        F.min_by(F.struct("t", "peak", "drawdown"), F.struct("drawdown", "t")).alias("w"), F.count("*").alias("n_obs")
    )
    worst = worst.select("series", "n_obs", F.col("w.t").alias("trough_t"), F.col("w.peak").alias("pk"), F.col("w.drawdown").alias("mdd"))
    out = dd.join(worst, "series").groupBy("series").agg(
        F.any_value("mdd").alias("max_drawdown"), F.any_value("n_obs").alias("n_obs"), F.any_value("trough_t").alias("trough_t"),
        F.max(F.when((F.col("t") <= F.col("trough_t")) & (F.col("value") == F.col("pk")), F.col("t"))).alias("peak_t"),
        F.min(F.when((F.col("t") > F.col("trough_t")) & (F.col("value") >= F.col("pk")), F.col("t"))).alias("back"),
    )
    flat = F.col("max_drawdown") == 0
    days = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 86_400e6
    out = out.withColumn("recovery_t", F.when(~flat, F.col("back")))
    return out.select(
        "series", "max_drawdown", "peak_t", "trough_t", "recovery_t",
        days(F.col("peak_t"), F.col("trough_t")).alias("decline_days"), days(F.col("trough_t"), F.col("recovery_t")).alias("recovery_days"), "n_obs",
        F.when(flat, F.lit("not_applicable")).when(F.col("recovery_t").isNull(), F.lit("not_recovered")).alias("absent"),
    )


# --- Beta --------------------------------------------------------------------------------------


def split_benchmark(inp: Series, benchmark: str) -> tuple[Series, Series]:
    """A table's asset series and its benchmark series."""
    if inp.series is None:
        raise Refusal("no_series_column", "A benchmark series needs a series column.")
    key = F.col(inp.series).cast("string")
    bench = inp.df.filter(key == benchmark)
    if bench.isEmpty():
        raise Refusal("unknown_series", f"There is no series '{benchmark}'.")
    make = lambda df, label, *notes: Series(df, inp.time, inp.series, inp.value, label, list(notes), inp.spread)
    return make(inp.df.filter(key != benchmark), inp.label), make(bench, "the benchmark", "one series")


def shared_returns(assets: Series, benchmark: Series, kind: str = "simple", period: str | None = None) -> DataFrame:
    """s, ts, a, b: returns of assets and benchmark between the times that both have."""
    (ta, tb) = single_timeframe(assets.df), single_timeframe(benchmark.df)
    if ta and tb and ta != tb and period is None:
        raise Refusal("mismatched_frequency", f"The assets' bars are {ta}, the benchmark's {tb}.", "Pass a period.")
    pa, pb = assets.points(positive=True), benchmark.points(positive=True)
    if benchmark.series is not None and "one series" not in benchmark.notes and pb.select("s").distinct().limit(2).count() > 1:
        raise Refusal("benchmark_not_single_series", "The benchmark has several series.")
    if period is not None:
        check_unique_times(pa, assets.label)
        check_unique_times(pb, benchmark.label)
    pa, pb = sampled(pa, period), sampled(pb, period).select("ts", F.col("v").alias("u"))
    w = Window.partitionBy("s").orderBy("ts")
    both = pa.join(pb, "ts").withColumn("t0", F.lag("ts").over(w)).withColumn("v0", F.lag("v").over(w)).withColumn("u0", F.lag("u").over(w))
    # A time that repeats on either side repeats here.
    both = both.filter("t0 IS NOT NULL").withColumn("v0", once(F.col("v0"), F.col("ts"), F.col("t0"), f"{assets.label} or {benchmark.label}"))
    return both.select("s", "ts", _change(kind, F.col("v"), F.col("v0")).alias("a"), _change(kind, F.col("u"), F.col("u0")).alias("b"))


def beta(assets: Series, benchmark: Series, kind: str = "simple", period: str | None = None, min_obs: int = 20) -> DataFrame:
    """series, beta, alpha, r_squared, n_obs, start, end and absent (why there is no beta), for every asset series."""
    rets = shared_returns(assets, benchmark, kind, period)
    stats = rets.groupBy("s").agg(
        F.count("*").alias("n"), F.covar_samp("a", "b").alias("c"), F.var_samp("b").alias("vb"), F.avg("a").alias("ma"), F.avg("b").alias("mb"),
        safe_corr(F.col("a"), F.col("b")).alias("r"), F.min("ts").alias("start"), F.max("ts").alias("end"),
    )
    names = assets.points(positive=True).select("s").distinct()
    enough = F.col("n") >= min_obs
    value = F.when(enough & (F.col("vb") > 0), ratio(F.col("c"), F.col("vb")))
    out = names.join(stats, "s", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("beta", value)
    return out.select(
        F.col("s").alias("series"), "beta", (F.col("ma") - F.col("beta") * F.col("mb")).alias("alpha"),
        F.when(F.col("beta").isNotNull(), F.col("r") * F.col("r")).alias("r_squared"), F.col("n").alias("n_obs"), "start", "end",
        F.when(F.col("n") == 0, F.lit("no_data")).when(~enough, F.lit("insufficient_data")).when(F.col("beta").isNull(), F.lit("not_applicable")).alias("absent"),
    )


def rolling_beta(assets: Series, benchmark: Series, window: int, kind: str = "simple", period: str | None = None) -> DataFrame:
    """series, t, start, beta, alpha, r_squared over the last `window` shared returns; full windows only."""
    _check_window(window)
    rets = shared_returns(assets, benchmark, kind, period)
    w = Window.partitionBy("s").orderBy("ts").rowsBetween(1 - window, 0)
    out = rets.select(
        "s", "ts", F.count("*").over(w).alias("n"), F.min("ts").over(w).alias("start"), F.covar_samp("a", "b").over(w).alias("c"),
        F.var_samp("b").over(w).alias("vb"), F.avg("a").over(w).alias("ma"), F.avg("b").over(w).alias("mb"), safe_corr(F.col("a"), F.col("b"), w).alias("r"),
    )
    out = out.filter(F.col("n") == window).withColumn("beta", F.when(F.col("vb") > 0, ratio(F.col("c"), F.col("vb"))))
    return out.select(
        F.col("s").alias("series"), F.col("ts").alias("t"), "start", "beta", (F.col("ma") - F.col("beta") * F.col("mb")).alias("alpha"),
        F.when(F.col("beta").isNotNull(), F.col("r") * F.col("r")).alias("r_squared"),
    )


def gap_counts(assets: Series, benchmark: Series) -> DataFrame:
    """series, gaps: returns that span observations which only one side has (their numbers jump by more than one)."""
    numbered = lambda p: p.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("ts")))
    a, b = numbered(assets.points(positive=True)), numbered(benchmark.points(positive=True)).select("ts", F.col("k").alias("j"))
    w = Window.partitionBy("s").orderBy("ts")
    both = a.join(b, "ts").withColumn("dk", F.col("k") - F.lag("k").over(w)).withColumn("dj", F.col("j") - F.lag("j").over(w))
    return both.groupBy(F.col("s").alias("series")).agg(F.count(F.when((F.col("dk") > 1) | (F.col("dj") > 1), 1)).alias("gaps"))
