"""The registered queries of the engine's own operators, each with the SQL that checks it.

Market data stand-ins: `events` are ticks (series event_type or user_id, value, tie-break event_id), daily means
of them are prices, and a lag that follows from event_id makes knowledge times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantidal.functions.numeric import finite, safe_corr
from vantidal.functions.timeframes import span_end, time_bucket
from vantidal.operators import analytics as an
from vantidal.operators.asof import Clock, align, asof_join
from vantidal.operators.points import Series
from vantidal.operators.relational import column_summary, latest_row, limit_percent, lookup, top_per_key, union_by_name, with_ties
from vantidal.operators.vintages import read_vintages, revisions, superseded
from vantidal.plans import guard
from vantidal.session import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query with the SQL that must give the same rows."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))


# --- Resampling --------------------------------------------------------------------------------

BARS_SQL = """SELECT event_type AS series, date_trunc('day', ts) AS t, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, round(sum(value), 6) AS volume, count(*) AS n
FROM events WHERE value IS NOT NULL GROUP BY ALL"""


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").filter("value IS NOT NULL")
    key = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("series"), time_bucket("1d", F.col("ts")).alias("t")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", key).alias("close"), F.round(F.sum("value"), 6).alias("volume"), F.count("*").alias("n"),
    )


query("resample_daily_bars", BARS_SQL)(daily_bars)


@query(
    "resample_weekly_bars",
    f"""WITH d AS ({BARS_SQL}) SELECT series, date_trunc('week', t) AS t, arg_min(open, t) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, t) AS close, round(sum(volume), 4) AS volume, sum(n)::BIGINT AS trade_count,
  round(sum((high + low) / 2 * volume) / sum(volume), 6) AS vwap, count(*) AS bars FROM d GROUP BY series, date_trunc('week', t)""",
)
def resample_weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily_bars(spark, sf_dir).withColumn("timeframe", F.lit("1d")).withColumn("vwap", (F.col("high") + F.col("low")) / 2)
    out = an.resample_bars(bars.withColumnRenamed("n", "trade_count"), "1w", "t", "series").drop("timeframe")
    return out.withColumn("volume", F.round("volume", 4)).withColumn("vwap", F.round("vwap", 6))


@query(
    "resample_mean_6h",
    """SELECT event_type, to_timestamp(floor(epoch(ts - TIMESTAMP '2000-01-03') / 21600) * 21600 + epoch(TIMESTAMP '2000-01-03'))::TIMESTAMP AS ts,
  round(avg(value), 8) AS value FROM events GROUP BY 1, 2""",
)
def resample_mean_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_type", "ts", "value", "event_id")
    return rounded(an.resample(e, "6h", "mean", "ts", "event_type", values=["value"], order="event_id").drop("timeframe"))


@query(
    "resample_last_quarter",
    """SELECT o_orderpriority, make_timestamp(year(o_orderdate), (((month(o_orderdate) - 1) // 3) * 3 + 1), 1, 0, 0, 0.0) AS o_orderdate,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1, 2""",
)
def resample_last_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderkey")
    return an.resample(o, "3mo", "last", "o_orderdate", "o_orderpriority", values=["o_totalprice"], order="o_orderkey").drop("timeframe")


@query(
    "time_bucket_5h",
    """SELECT to_timestamp(floor(epoch(ts - TIMESTAMP '2000-01-03') / 18000) * 18000 + epoch(TIMESTAMP '2000-01-03'))::TIMESTAMP AS t, count(*) AS n
FROM events GROUP BY 1""",
)
def time_bucket_5h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(time_bucket("5h", F.col("ts")).alias("t")).agg(F.count("*").alias("n"))


@query(
    "span_end_mixed",
    """WITH s AS (SELECT event_id, date_trunc('day', ts) AS t, ['15min','4h','1d','1w','3mo'][1 + event_id % 5] AS span FROM events)
SELECT event_id, CASE span WHEN '15min' THEN t + INTERVAL 15 MINUTE WHEN '4h' THEN t + INTERVAL 4 HOUR WHEN '1d' THEN t + INTERVAL 1 DAY
  WHEN '1w' THEN t + INTERVAL 7 DAY ELSE t + INTERVAL 3 MONTH END AS ends FROM s""",
)
def span_end_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("t", F.date_trunc("day", "ts"))
    spans = F.array(*(F.lit(x) for x in ("15min", "4h", "1d", "1w", "3mo")))
    return e.select("event_id", span_end(F.col("t"), F.get(spans, (F.col("event_id") % 5).cast("int"))).alias("ends"))


# --- Returns, volatility, correlation, drawdown, beta ------------------------------------------------

DAILY = """daily AS (SELECT event_type AS s, date_trunc('day', ts) AS ts, round(avg(value), 9) AS v FROM events
  WHERE value IS NOT NULL AND isfinite(value) GROUP BY ALL HAVING avg(value) > 0)"""


def daily(spark: SparkSession, sf_dir: str) -> Series:
    e = load(spark, sf_dir, "events").filter(F.col("value").isNotNull() & finite(F.col("value")))
    d = e.groupBy(F.col("event_type").alias("s"), F.date_trunc("day", "ts").alias("ts")).agg(F.round(F.avg("value"), 9).alias("v"))
    return Series(d.filter("v > 0"), "ts", "s", "v", "daily means")


def _returns(kind: str, period: str | None) -> Query:
    return lambda spark, sf_dir: rounded(an.returns(daily(spark, sf_dir), kind, period)).drop("period", "kind")


def _returns_sql(expr: str, points: str = "daily") -> str:
    return f"""WITH {DAILY}, weekly AS (SELECT s, date_trunc('week', ts) AS b, arg_max(v, ts) AS v FROM daily GROUP BY ALL),
w AS (SELECT s, b AS ts, v FROM weekly)
SELECT s AS series, ts AS t, round({expr}, 8) AS ret FROM (SELECT *, lag(v) OVER (PARTITION BY s ORDER BY ts) AS v0 FROM {points}) WHERE v0 IS NOT NULL"""


query("returns_simple", _returns_sql("v / v0 - 1"))(_returns("simple", None))
query("returns_log", _returns_sql("ln(v / v0)"))(_returns("log", None))
query("returns_weekly", _returns_sql("v / v0 - 1", "w"))(_returns("simple", "1w"))

RETS = f"""{DAILY}, r AS (SELECT s, ts, ln(v / v0) AS r FROM
  (SELECT *, lag(v) OVER (PARTITION BY s ORDER BY ts) AS v0 FROM daily) WHERE v0 IS NOT NULL)"""


@query(
    "volatility_rolling",
    f"""WITH {RETS} SELECT s AS series, ts AS t, start, round(vol * sqrt(252), 8) AS volatility, n AS n_obs FROM (
  SELECT s, ts, stddev_samp(r) OVER w AS vol, count(*) OVER w AS n, min(ts) OVER w AS start FROM r
  WINDOW w AS (PARTITION BY s ORDER BY ts ROWS 4 PRECEDING)) WHERE n = 5""",
)
def volatility_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(an.volatility(daily(spark, sf_dir), 5, periods=252))


@query(
    "volatility_all",
    f"""WITH {RETS}, d AS (SELECT median(n) AS per_day FROM (SELECT s, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS d, count(*) AS n FROM r GROUP BY ALL))
SELECT s AS series, max(ts) AS t, min(ts) AS start, round(stddev_samp(r) * sqrt(252 * any_value(per_day)), 8) AS volatility, count(*) AS n_obs FROM r, d GROUP BY s HAVING count(*) >= 2""",
)
def volatility_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annualised by the number of returns that are seen."""
    return rounded(an.volatility(daily(spark, sf_dir), "all"))


def _corr_sql(change: str) -> str:
    return f"""WITH {DAILY}, p AS (SELECT a.s AS x, b.s AS y, a.ts, a.v AS v, b.v AS u FROM daily a JOIN daily b USING (ts)),
c AS (SELECT x, y, ts, {change} FROM p WINDOW w AS (PARTITION BY x, y ORDER BY ts)),
st AS (SELECT x, y, corr(v, u) AS c, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY x, y), n AS (SELECT DISTINCT s FROM daily)
SELECT a.s AS series_a, b.s AS series_b, coalesce(n, 0) AS n_obs,
  round(CASE WHEN n >= 20 THEN CASE WHEN a.s = b.s THEN 1.0 WHEN isnan(c) THEN NULL ELSE greatest(-1.0, least(1.0, c)) END END, 8) AS correlation
FROM n a CROSS JOIN n b LEFT JOIN st ON a.s = st.x AND b.s = st.y"""


@query("correlation_returns", _corr_sql("v / lag(v) OVER w - 1 AS v, u / lag(u) OVER w - 1 AS u"))
def correlation_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(an.correlation(daily(spark, sf_dir)))


@query("correlation_levels", _corr_sql("v, u"))
def correlation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(an.correlation(daily(spark, sf_dir), "levels"))


DD = f"""{DAILY}, dd AS (SELECT * FROM (SELECT s, ts, v, max(v) OVER (PARTITION BY s ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pk,
  count(*) OVER (PARTITION BY s) AS n FROM daily) WHERE n >= 2)"""


@query("drawdown_series", f"WITH {DD} SELECT s AS series, ts AS t, v AS value, pk AS peak, round(v / pk - 1, 8) AS drawdown FROM dd")
def drawdown_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.drawdown_series(daily(spark, sf_dir)).withColumn("drawdown", F.round("drawdown", 8))


@query(
    "drawdown_max",
    f"""WITH {DD}, w AS (SELECT s, arg_min(ts, (v / pk - 1, ts)) AS trough_t, min(v / pk - 1) AS mdd, arg_min(pk, (v / pk - 1, ts)) AS p, count(*) AS k FROM dd GROUP BY s),
o AS (SELECT w.s, any_value(mdd) AS mdd, any_value(k) AS n, any_value(trough_t) AS trough_t, max(ts) FILTER (WHERE ts <= trough_t AND v = p) AS peak_t,
  min(ts) FILTER (WHERE ts > trough_t AND v >= p) AS back FROM dd JOIN w USING (s) GROUP BY w.s)
SELECT s AS series, round(mdd, 8) AS max_drawdown, peak_t, trough_t, CASE WHEN mdd < 0 THEN back END AS recovery_t,
  round(epoch(trough_t - peak_t) / 86400, 8) AS decline_days, round(epoch(CASE WHEN mdd < 0 THEN back END - trough_t) / 86400, 8) AS recovery_days, n AS n_obs,
  CASE WHEN mdd = 0 THEN 'not_applicable' WHEN back IS NULL THEN 'not_recovered' END AS absent FROM o""",
)
def drawdown_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(an.drawdown_max(daily(spark, sf_dir)))


BETA = f"""{DAILY}, j AS (SELECT a.s, a.ts, a.v / lag(a.v) OVER w - 1 AS a, b.v / lag(b.v) OVER w - 1 AS b
  FROM daily a JOIN daily b ON a.ts = b.ts AND b.s = 'click' WHERE a.s <> 'click' WINDOW w AS (PARTITION BY a.s ORDER BY a.ts))"""


@query(
    "beta_static",
    f"""WITH {BETA} SELECT s AS series, round(covar_samp(a, b) / var_samp(b), 8) AS beta, round(avg(a) - covar_samp(a, b) / var_samp(b) * avg(b), 8) AS alpha,
  round(corr(a, b) * corr(a, b), 8) AS r_squared, count(*) AS n_obs, min(ts) AS start, max(ts) AS "end", CAST(NULL AS VARCHAR) AS absent FROM j WHERE a IS NOT NULL GROUP BY s""",
)
def beta_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(an.beta(*an.split_benchmark(daily(spark, sf_dir), "click")))


@query(
    "beta_rolling",
    f"""WITH {BETA}, k AS (SELECT s, ts, min(ts) OVER w AS start, count(*) OVER w AS n, covar_samp(a, b) OVER w AS c, var_samp(b) OVER w AS vb, avg(a) OVER w AS ma,
  avg(b) OVER w AS mb, corr(a, b) OVER w AS r FROM j WHERE a IS NOT NULL WINDOW w AS (PARTITION BY s ORDER BY ts ROWS 4 PRECEDING))
SELECT s AS series, ts AS t, start, round(c / vb, 6) AS beta, round(ma - c / vb * mb, 6) AS alpha, round(r * r, 6) AS r_squared FROM k WHERE n = 5""",
)
def beta_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(an.rolling_beta(*an.split_benchmark(daily(spark, sf_dir), "click"), 5), 6)


# --- As-of joins and vintages ------------------------------------------------------------------------


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    left = e.filter("event_type = 'click'").select("event_id", "ts", "user_id")
    right = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max(F.struct("event_id", "value")).alias("m"))
    return left, right.select("user_id", F.col("ts").alias("seen"), F.col("m.value").alias("value"))


SIDES = """l AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, ts AS seen, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)"""


@query("asof_backward", f"WITH {SIDES} SELECT event_id, l.ts, l.user_id, r.seen AS matched_t, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.seen")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return asof_join(left, right, "ts", "seen", [("user_id", "user_id")])


@query("asof_forward", f"WITH {SIDES} SELECT event_id, l.ts, l.user_id, r.seen AS matched_t, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.seen")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return asof_join(left, right, "ts", "seen", [("user_id", "user_id")], "forward")


@query(
    "asof_tolerance",
    f"""WITH {SIDES} SELECT event_id, l.ts, l.user_id, CASE WHEN l.ts - r.seen <= INTERVAL 2 HOUR THEN r.seen END AS matched_t,
  CASE WHEN l.ts - r.seen <= INTERVAL 2 HOUR THEN r.value END AS value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.seen""",
)
def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return asof_join(left, right, "ts", "seen", [("user_id", "user_id")], tolerance="PT2H")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").filter("event_type = 'view'")
    known = F.timestamp_micros(F.unix_micros("ts") + F.pmod(F.col("event_id") * 7919, F.lit(200_000)) * 1_000_000)
    return e.select("user_id", F.date_trunc("day", "ts").alias("day"), known.alias("knowledge_time"), "value", "event_id")


VERSIONS = """v AS (SELECT user_id, date_trunc('day', ts) AS day, ts + to_seconds((event_id * 7919) % 200000) AS knowledge_time, value, event_id
  FROM events WHERE event_type = 'view')"""


@query(
    "align_available",
    f"""WITH l AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'click'), {VERSIONS},
k AS (SELECT *, greatest(day, knowledge_time) AS rk FROM v), d AS (SELECT * FROM (SELECT *, max(day) OVER (PARTITION BY user_id ORDER BY rk RANGE UNBOUNDED PRECEDING) AS newest FROM k)
  WHERE day >= newest QUALIFY row_number() OVER (PARTITION BY user_id, rk ORDER BY day DESC) = 1)
SELECT l.event_id, l.ts, l.user_id, d.day AS matched_t, d.value FROM l ASOF LEFT JOIN d ON l.user_id = d.user_id AND l.ts >= d.rk""",
)
def align_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the newest day's value that was known by then."""
    left, _ = sides(spark, sf_dir)
    return align(left, versions(spark, sf_dir), "ts", "day", [("user_id", "user_id")], right_columns=["value"], clock=Clock(column="knowledge_time")).df


@query(
    "vintages_latest",
    f"WITH {VERSIONS} SELECT user_id, day, max(knowledge_time) AS knowledge_time, arg_max(value, (knowledge_time, event_id)) AS value, arg_max(event_id, (knowledge_time, event_id)) AS event_id FROM v GROUP BY ALL",
)
def vintages_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_vintages(versions(spark, sf_dir), ["user_id", "day"], tie=["event_id"])


@query(
    "vintages_as_of",
    f"""WITH {VERSIONS} SELECT user_id, day, max(knowledge_time) AS knowledge_time, arg_max(value, (knowledge_time, event_id)) AS value, arg_max(event_id, (knowledge_time, event_id)) AS event_id
FROM v WHERE knowledge_time <= TIMESTAMP '2024-01-15 12:00:00' AND day >= TIMESTAMP '2024-01-05' GROUP BY ALL""",
)
def vintages_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_vintages(versions(spark, sf_dir), ["user_id", "day"], as_of="2024-01-15 12:00:00", time="day", start="2024-01-05", tie=["event_id"])


@query(
    "vintages_revisions",
    f"""WITH {VERSIONS}, u AS (SELECT user_id, day, knowledge_time, max(value) AS value FROM v GROUP BY ALL)
SELECT user_id, day, count(*) AS versions, arg_min(value, knowledge_time) AS first_value, arg_max(value, knowledge_time) AS last_value,
  round(arg_max(value, knowledge_time) - arg_min(value, knowledge_time), 8) AS moved FROM u GROUP BY user_id, day""",
)
def vintages_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir).groupBy("user_id", "day", "knowledge_time").agg(F.max("value").alias("value"))
    return revisions(v, ["user_id", "day"], "value").withColumn("moved", F.round("moved", 8))


@query(
    "vintages_superseded",
    f"WITH {VERSIONS} SELECT event_id FROM v WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.user_id = v.user_id AND w.day = v.day AND w.knowledge_time > v.knowledge_time)",
)
def vintages_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir)
    return superseded(v, v, ["user_id", "day"])[0].select("event_id")


# --- Relational --------------------------------------------------------------------------------


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [load(spark, sf_dir, n) for n in names]


@query(
    "join_inner_revenue",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n_name""",
)
def join_inner_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, n = _tables(spark, sf_dir, "lineitem", "orders", "customer", "nation")
    j = li.join(o.filter(F.col("o_orderdate") >= "1996-01-01"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def _join(how: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, o = _tables(spark, sf_dir, "customer", "orders")
        few = o.filter("o_totalprice > 300000").select("o_orderkey", "o_custkey")
        out = c.filter("c_acctbal > 0").join(few, F.col("c_custkey") == F.col("o_custkey"), how)
        return out.select("c_custkey", *(["o_orderkey"] if "semi" not in how and "anti" not in how else []))

    return f


_FEW = "(SELECT * FROM customer WHERE c_acctbal > 0) c {} JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey"
for _how, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    query(f"join_{_how}", f"SELECT c_custkey, o_orderkey FROM {_FEW.format(_sql)}")(_join(_how))
for _how, _sql in (("left_semi", "SEMI"), ("left_anti", "ANTI")):
    query(f"join_{_how[5:]}", f"SELECT c_custkey FROM {_FEW.format(_sql)}")(_join(_how))


@query(
    "join_theta",
    "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
)
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    j = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return j.select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("join_grid", "SELECT r_name, p.o_orderpriority FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p")
def join_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five regions by five priorities: both sides are bounded by their vocabularies."""
    r, o = _tables(spark, sf_dir, "region", "orders")
    return r.select("r_name").crossJoin(F.broadcast(o.select("o_orderpriority").distinct()))


@query(
    "lookup_absent",
    """SELECT o_orderkey, c_name, CASE WHEN c_name IS NULL THEN 'not_found' END AS why FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey""",
)
def lookup_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _tables(spark, sf_dir, "orders", "customer")
    dim = c.filter("c_acctbal > 5000").withColumnRenamed("c_custkey", "o_custkey")
    out = lookup(o.select("o_orderkey", "o_custkey"), dim, ["o_custkey"], ["c_name"])
    return out.select("o_orderkey", "c_name", F.try_element_at("absent", F.lit("c_name")).alias("why"))


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= "1998-09-02")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


def _grouping(how: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = load(spark, sf_dir, "orders")
        keys = [F.col("o_orderstatus"), F.col("o_orderpriority")]
        g = {"rollup": o.rollup, "cube": o.cube}[how](*keys)
        return g.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.max("o_totalprice").alias("most"))

    return f


for _how in ("rollup", "cube"):
    query(
        f"group_{_how}",
        f"SELECT o_orderstatus, o_orderpriority, (grouping(o_orderstatus) * 2 + grouping(o_orderpriority))::BIGINT AS level, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY {_how.upper()} (o_orderstatus, o_orderpriority)",
    )(_grouping(_how))


@query(
    "group_sets",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))",
)
def group_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.groupingSets([[o.o_orderstatus], [o.o_orderpriority]], o.o_orderstatus, o.o_orderpriority).agg(F.count("*").alias("n"))


@query(
    "agg_filter_having",
    """SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds, count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
  max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS most_open FROM orders GROUP BY o_custkey HAVING count(*) >= 10""",
)
def agg_filter_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("kinds"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"),
        F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("most_open"),
    ).filter("n >= 10")


@query(
    "agg_statistics",
    """SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS q90, round(skewness(value), 4) AS skew,
  round(stddev_samp(value), 6) AS sd, round(var_samp(value), 4) AS var, round(regr_slope(value, user_id), 8) AS slope, round(regr_intercept(value, user_id), 6) AS intercept,
  round(exp(avg(ln(value)) FILTER (WHERE value > 0)), 6) AS geo, bit_xor(event_id) AS bits, bool_and(value IS NOT NULL) AS whole, round(covar_samp(value, user_id), 4) AS cov FROM events GROUP BY event_type""",
)
def agg_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    n, m, s2 = F.count("value"), F.skewness("value"), None  # Spark's skewness is of the population
    del s2
    skew = m * F.sqrt(n * (n - 1.0)) / (n - 2.0)
    return e.groupBy("event_type").agg(
        F.round(F.median("value"), 6).alias("med"), F.round(F.percentile("value", 0.9), 6).alias("q90"), F.round(skew, 4).alias("skew"),
        F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.var_samp("value"), 4).alias("var"), F.round(F.regr_slope("value", "user_id"), 8).alias("slope"),
        F.round(F.regr_intercept("value", "user_id"), 6).alias("intercept"), F.round(F.exp(F.avg(F.log(F.when(F.col("value") > 0, F.col("value"))))), 6).alias("geo"),
        F.bit_xor("event_id").alias("bits"), F.bool_and(F.col("value").isNotNull()).alias("whole"), F.round(F.covar_samp("value", "user_id"), 4).alias("cov"),
    )


@query(
    "corr_constant_is_null",
    "SELECT event_type, CAST(NULL AS DOUBLE) AS flat, round(corr(value, user_id), 8) AS c FROM events GROUP BY event_type",
)
def corr_constant_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(safe_corr(F.col("value"), F.lit(1.0)).alias("flat"), F.round(safe_corr(F.col("value"), F.col("user_id").cast("double")), 8).alias("c"))


@query(
    "window_ranks",
    """SELECT event_id, row_number() OVER w AS rn, rank() OVER d AS rk, dense_rank() OVER d AS dr, round(percent_rank() OVER d, 8) AS pr, round(cume_dist() OVER d, 8) AS cd, ntile(4) OVER w AS q,
  lag(value) OVER w AS before, lead(value, 2) OVER w AS after2, first_value(value) OVER w AS first, nth_value(value, 2) OVER w AS second,
  round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 8) AS near
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), d AS (PARTITION BY user_id ORDER BY event_type)""",
)
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    w, d = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("event_type")
    return e.select(
        "event_id", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(d).cast("long").alias("rk"), F.dense_rank().over(d).cast("long").alias("dr"), F.round(F.percent_rank().over(d), 8).alias("pr"),
        F.round(F.cume_dist().over(d), 8).alias("cd"), F.ntile(4).over(w).cast("long").alias("q"), F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after2"),
        F.first("value").over(w).alias("first"), F.nth_value("value", 2).over(w).alias("second"), F.round(F.avg("value").over(w.rowsBetween(-2, 1)), 8).alias("near"),
    )


@query("top_per_key", "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank FROM events) WHERE rank <= 3")
def top_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return top_per_key(e, ["user_id"], 3, F.col("value").desc_nulls_last(), F.col("event_id")).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("latest_row", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return latest_row(e, ["user_id"], "ts", "event_id").select("user_id", "event_id", "value")


@query("limit_with_ties", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def limit_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ties(load(spark, sf_dir, "part").select("p_partkey", "p_size"), 10, ("p_size", "desc"))


@query("limit_percent", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT count(*) * 5 // 100 FROM orders)")
def five_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return limit_percent(o, 5, F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_orderkey")


@query(
    "set_operations",
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL
SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL
SELECT 'except_all', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer) UNION ALL
SELECT 'by_name', count(*) FROM (SELECT o_custkey AS k, o_orderkey AS x FROM orders UNION ALL BY NAME SELECT c_custkey AS k FROM customer) WHERE x IS NULL""",
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _tables(spark, sf_dir, "orders", "customer")
    a, b = o.select(F.col("o_custkey").alias("k")), c.select(F.col("c_custkey").alias("k"))
    named = union_by_name(o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("x")), b).filter("x IS NULL")
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": b.subtract(a), "except_all": a.exceptAll(b), "by_name": named.select("k")}
    out = None
    for op, df in made.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.union(one)
    return out


@query("unpivot", "SELECT l_orderkey, l_linenumber, name, round(value, 4) AS value FROM (SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem) UNPIVOT (value FOR name IN (l_tax, l_discount))")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return li.unpivot(["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"], "name", "value").withColumn("value", F.round("value", 4))


@query(
    "scalar_functions",
    """SELECT o_orderkey, upper(o_orderpriority) AS u, substr(o_orderpriority, 1, 3) AS p3, replace(o_orderpriority, '-', '_') AS rep, string_split(o_orderpriority, '-')[1] AS first,
  regexp_extract(o_orderpriority, '([A-Z]+)', 1) AS word, lpad(o_orderstatus, 3, '*') AS pad, o_orderpriority ILIKE '%urgent%' AS urgent, coalesce(nullif(o_orderstatus, 'F'), 'done') AS st,
  greatest(o_custkey, 100) AS g, round(ln(o_totalprice), 8) AS l, floor(o_totalprice / 1000) AS k, year(o_orderdate) AS y, date_trunc('month', o_orderdate) AS m,
  date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS days, strftime(o_orderdate, '%Y-%m-%d') AS iso, try_cast(o_orderpriority AS INTEGER) AS no FROM orders""",
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = load(spark, sf_dir, "orders"), F.col("o_orderpriority")
    return o.select(
        "o_orderkey", F.upper(p).alias("u"), F.substring(p, 1, 3).alias("p3"), F.replace(p, F.lit("-"), F.lit("_")).alias("rep"), F.get(F.split(p, "-"), F.lit(0)).alias("first"),
        F.regexp_extract(p, "([A-Z]+)", 1).alias("word"), F.lpad("o_orderstatus", 3, "*").alias("pad"), p.ilike("%urgent%").alias("urgent"),
        F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("F")), F.lit("done")).alias("st"), F.greatest(F.col("o_custkey"), F.lit(100)).alias("g"), F.round(F.log("o_totalprice"), 8).alias("l"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("k"), F.year("o_orderdate").cast("long").alias("y"), F.date_trunc("month", "o_orderdate").alias("m"),
        F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate")).cast("long").alias("days"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), p.try_cast("int").alias("no"),
    )


@query(
    "collections",
    """SELECT user_id, len(l) AS n, list_contains(l, 'click') AS clicked, len(list_filter(l, lambda x: x = 'view')) AS views, list_sort(list_distinct(l)) AS kinds
FROM (SELECT user_id, list(event_type) AS l FROM events GROUP BY user_id)""",
)
def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("l"))
    return g.select(
        "user_id", F.size("l").cast("long").alias("n"), F.array_contains("l", "click").alias("clicked"), F.size(F.filter("l", lambda x: x == "view")).cast("long").alias("views"),
        F.array_sort(F.array_distinct("l")).alias("kinds"),
    )


@query(
    "unnest_words",
    "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY word",
)
def unnest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(
    "column_summary",
    """SELECT 0 AS position, 'o_orderkey' AS "column", count(*) FILTER (WHERE o_orderkey IS NULL) AS nulls, min(o_orderkey)::VARCHAR AS least, max(o_orderkey)::VARCHAR AS greatest FROM orders UNION ALL
SELECT 1, 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus IS NULL), min(o_orderstatus), max(o_orderstatus) FROM orders""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_summary(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")).drop("kind")


# --- Guarded SQL ---------------------------------------------------------------------------------


def guarded(name: str, sql: str, oracle: str, tables: tuple[str, ...], most: int | None = None) -> None:
    """A statement that goes through the guard over named tables."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return guard.run(spark, sql, {t: load(spark, sf_dir, t) for t in tables}, most)

    query(name, oracle)(f)


guarded(
    "sql_qualify",
    "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1",
    "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1",
    ("events",),
)
guarded(
    "sql_exclude",
    "SELECT * EXCLUDE (o_orderdate, o_custkey) FROM orders WHERE o_totalprice > 400000",
    "SELECT * EXCLUDE (o_orderdate, o_custkey) FROM orders WHERE o_totalprice > 400000",
    ("orders",),
)
guarded(
    "sql_arg_max",
    "SELECT event_type, arg_max(event_id, struct(ts, event_id)) AS last_id, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY ALL",
    "SELECT event_type, arg_max(event_id, (ts, event_id)) AS last_id, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY ALL",
    ("events",),
)
guarded(
    "sql_time_bucket",
    "SELECT time_bucket(INTERVAL '5 hours', ts) AS t, count(*) AS n FROM events GROUP BY ALL",
    SQL["time_bucket_5h"],
    ("events",),
)
guarded(
    "sql_union_by_name",
    "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal > 9000 UNION ALL BY NAME SELECT s_name AS name FROM supplier",
    "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal > 9000 UNION ALL BY NAME SELECT s_name AS name FROM supplier",
    ("customer", "supplier"),
)
guarded(
    "sql_recursive",
    "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM r WHERE n < 20) SELECT n, f FROM r",
    "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM r WHERE n < 20) SELECT n, f FROM r",
    (),
)
guarded(
    "sql_subqueries",
    "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    ("customer", "orders", "nation"),
)
guarded(
    "sql_lateral",
    "SELECT n_name, x.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) x",
    "SELECT n_name, x.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) x",
    ("nation", "supplier"),
)
_CLICKS = "SELECT event_id, ts, user_id FROM events WHERE event_type = 'click'"


@query("sql_asof_join", SQL["asof_backward"].replace("r.seen AS matched_t, ", "r.seen, "))
def sql_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    sql = "SELECT l.event_id, l.ts, l.user_id, r.seen, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.seen"
    return guard.run(spark, sql, {"l": left, "r": right}, None)
