"""Registered queries of the store, the sources, the dataset reader and its rules, point-in-time lineage, long series and streams."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.catalog import (
    DAILY, SQL, VERSIONS, daily, daily_bars, query, rounded, sides, versions,
)
from vantidal.operators import analytics as an
from vantidal.operators import market
from vantidal.operators.asof import Clock, align, asof_join
from vantidal.operators.pit import Known, RowsOf, bucketed, lost_clocks, of_query
from vantidal.operators.points import Series
from vantidal.operators.relational import ordered
from vantidal.plans.lineage import lineage
from vantidal.schema.models import conform, exact_decimal, model, unexplained
from vantidal.session import load, shared_dir
from vantidal.sources import datasets as ds
from vantidal.sources import parsing, windows
from vantidal.sources.tools import TOOLS, read_tool
from vantidal.store.results import ResultStore, csv_ready, export, json_ready, sampled

# --- The store -----------------------------------------------------------------------------------


def _store(spark: SparkSession) -> ResultStore:
    return ResultStore(spark, f"queries-{uuid.uuid4().hex[:8]}")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("store_put_read", "SELECT event_id, user_id, value FROM events")
def store_put_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    return store.read(store.put(_events(spark, sf_dir), "events", time="ts", group="user_id").result_id, ["event_id", "user_id", "value"])


@query("store_query", "SELECT event_type, count(*) AS n, max(value) AS most FROM events WHERE user_id < 50 GROUP BY event_type")
def store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    rid = store.put(_events(spark, sf_dir), "events", time="ts", group="user_id").result_id
    return store.query(f"SELECT event_type, count(*) AS n, max(value) AS most FROM {rid} WHERE user_id < 50 GROUP BY event_type", seconds=120)


@query("store_forced_limit", "SELECT event_id FROM events ORDER BY event_id LIMIT 101")
def store_forced_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rows and one more, which tells that there are more."""
    store = _store(spark)
    rid = store.put(_events(spark, sf_dir), "events").result_id
    return store.query(f"SELECT event_id FROM {rid} ORDER BY event_id", most=100, seconds=120)


@query(
    "store_describe",
    """SELECT 'event_id' AS name, 0::BIGINT AS nulls, min(event_id)::VARCHAR AS least, max(event_id)::VARCHAR AS greatest, count(*) AS n FROM events
UNION ALL SELECT 'event_type', 0, min(event_type), max(event_type), count(*) FROM events""",
)
def store_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    info = store.info(store.put(_events(spark, sf_dir).select("event_id", "event_type"), "events").result_id)
    return spark.createDataFrame([(c.name, c.nulls, c.least, c.greatest, info.rows) for c in info.columns], "name string, nulls long, least string, greatest string, n long")


@query("store_list_drop", "SELECT 3::BIGINT AS kept, 1::BIGINT AS dropped, 0::BIGINT AS other")
def store_list_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one session: listed, one dropped, and none seen by another session."""
    store, e = _store(spark), load(spark, sf_dir, "region")
    ids = [store.put(e, "region").result_id for _ in range(4)]
    gone = store.drop(ids[1])
    return spark.createDataFrame([(len(store.list()), gone, len(_store(spark).list()))], "kept long, dropped long, other long")


for _method, _order in (("first", "ASC"), ("last", "DESC")):

    def _sampled(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        store = _store(spark)
        return sampled(store, store.put(_events(spark, sf_dir), "events", time="ts").result_id, 20, method, ["event_id", "value"])

    query(f"store_sample_{_method}", f"SELECT event_id, value FROM events ORDER BY ts {_order} LIMIT 20")(_sampled)


@query("export_csv", "SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN '''=' || event_type ELSE event_type END AS said, '[' || event_id || ',' || user_id || ']' AS pair FROM events")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV, lists as JSON text, formulas disarmed, and read back."""
    store = _store(spark)
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("="), "event_type")).otherwise(F.col("event_type"))
    df = _events(spark, sf_dir).select("event_id", "event_type", said.alias("said"), F.array("event_id", "user_id").alias("pair"))
    path = export(store, store.put(df, "events").result_id, f"{shared_dir(spark)}/export-{uuid.uuid4().hex}.csv", "csv")
    return spark.read.option("header", True).option("escape", '"').schema("event_id long, event_type string, said string, pair string").csv(path)


@query("export_parquet", "SELECT event_id, ts, value FROM events")
def export_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    rid = store.put(_events(spark, sf_dir).select("event_id", "ts", "value"), "events").result_id
    return spark.read.parquet(export(store, rid, f"{shared_dir(spark)}/export-{uuid.uuid4().hex}.parquet"))


@query("json_egress", """SELECT '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","kind":' || CASE WHEN event_id % 2 = 0 THEN '"' || event_type || '"' ELSE 'null' END || '}' AS json FROM events""")
def json_egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    return json_ready(_events(spark, sf_dir).select("event_id", "ts", kind.alias("kind")))


@query("csv_formulas", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN '''' ELSE '' END || ['=', '', 'a', '1'][n_nationkey % 4 + 1] || n_name AS x FROM nation")
def csv_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.get(F.array(*(F.lit(x) for x in ("=", "", "a", "1"))), (F.col("n_nationkey") % 4).cast("int"))
    return csv_ready(load(spark, sf_dir, "nation").select("n_nationkey", F.concat(start, "n_name").alias("x")))


@query("nulls_last", "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS v FROM events WHERE event_id < 200) ORDER BY v NULLS LAST, event_id LIMIT 150")
def nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_id < 200").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("v"))
    return ordered(e, "v", "event_id").limit(150)


# --- Parsing and models ----------------------------------------------------------------------------


@query(
    "parse_instants",
    """SELECT event_id, ts AS a, date_trunc('second', ts) AS b, ((event_id % 50) * 60 + 0.5)::DOUBLE AS c, (event_id % 1000) / 100.0 AS d FROM events""",
)
def parse_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text written from the table and parsed back: nine fractional digits, an offset, a duration, a percentage."""
    e = _events(spark, sf_dir)
    nine = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))
    shifted = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    lasts = F.concat(F.lit("PT"), (F.col("event_id") % 50).cast("string"), F.lit("M0.5S"))
    percent = F.col("event_id") % 1000
    return e.select("event_id", parsing.instant(nine).alias("a"), parsing.instant(shifted).alias("b"), parsing.duration_seconds(lasts).alias("c"), parsing.fraction(percent).alias("d"))


@query(
    "parse_options",
    """SELECT p_partkey, 'AB' AS root, DATE '2026-01-01' + (p_partkey % 300)::INT AS expiration, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS kind, (p_partkey % 5000) / 8.0 AS strike,
  CASE WHEN p_partkey % 3 = 0 THEN 'BRK.B' END AS ticker FROM part""",
)
def parse_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int"))
    strike = F.lpad(((F.col("p_partkey") % 5000) * 125).cast("string"), 8, "0")
    text = F.concat(F.lit("ab  "), F.date_format(day, "yyMMdd"), F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("P"), strike)
    o = parsing.option_symbol(text)
    ticker = parsing.ticker(F.when(F.col("p_partkey") % 3 == 0, F.lit(" brk-b ")).otherwise(F.lit("not a ticker")))
    return p.select("p_partkey", o["root"].alias("root"), o["expiration"].alias("expiration"), o["kind"].alias("kind"), o["strike"].alias("strike"), ticker.alias("ticker"))


@query("exact_decimals", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice::DECIMAL(38,12) END AS d FROM orders")
def exact_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals from text: what has more digits than can be held is null, never rounded."""
    money = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    text = F.when(F.col("o_orderkey") % 4 > 0, money).otherwise(F.concat(money, F.lit("0000000000001")))
    return load(spark, sf_dir, "orders").select("o_orderkey", exact_decimal(text).alias("d"))


TICK = model("Tick", "ticker:str t:time price:float? size:float? venue:str?", "t", "ticker", "price size", "price=price")


@query(
    "model_absence",
    """SELECT event_id::VARCHAR AS ticker, ts AS t, CASE WHEN event_id % 2 = 0 THEN value END AS price, CASE WHEN event_id % 2 = 0 THEN 'venue:not_reported' ELSE 'price:withheld,venue:not_reported' END AS why, 0::BIGINT AS unexplained FROM events""",
)
def model_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a model's columns: every null has its reason, and none stays unexplained."""
    e = _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("ticker"), F.col("ts").alias("t"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("price"), F.lit(1.0).alias("size"))
    rows = conform(e, TICK, {"price": "withheld"})
    left = unexplained(rows, TICK).groupBy("ticker").agg(F.count("*").alias("unexplained"))
    why = F.concat_ws(",", F.array_sort(F.transform(F.map_entries("absent"), lambda x: F.concat(x["key"], F.lit(":"), x["value"]))))
    return rows.join(left, "ticker", "left").select("ticker", "t", "price", why.alias("why"), F.coalesce("unexplained", F.lit(0)).alias("unexplained"))


# --- Market tables -------------------------------------------------------------------------------


@query(
    "order_book",
    """WITH l AS (SELECT user_id::VARCHAR AS ticker, date_trunc('day', ts) AS t, CASE WHEN event_type = 'click' THEN 'bid' ELSE 'ask' END AS side, value AS price, (event_id % 4)::DOUBLE AS size
  FROM events WHERE event_type IN ('click', 'view') AND event_id % 4 > 0)
SELECT ticker, t, side, level, price, size FROM (SELECT *, row_number() OVER (PARTITION BY ticker, t, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, size) - 1 AS level FROM l) WHERE level < 3""",
)
def order_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    level = F.struct(F.col("value").alias("p"), (F.col("event_id") % 4).cast("double").alias("s"))
    of = lambda kind: F.collect_list(F.when(F.col("event_type") == kind, level))
    books = e.groupBy(F.col("user_id").cast("string").alias("ticker"), F.date_trunc("day", "ts").alias("t")).agg(of("click").alias("bids"), of("view").alias("asks"))
    return market.order_book(books, 3).withColumn("level", F.col("level").cast("long"))


SNAPSHOTS = """s AS (SELECT c_name AS ticker, c_acctbal AS last_price, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal + 1 END AS day_close, CASE WHEN c_custkey % 7 > 0 THEN c_custkey::DOUBLE END AS prev_close, c_custkey FROM customer),
b AS (SELECT *, CASE WHEN day_close IS NULL OR c_custkey % 2 = 0 THEN 'last_trade' ELSE 'day_close' END AS basis FROM s),
c AS (SELECT ticker, last_price, CASE WHEN basis = 'last_trade' THEN last_price ELSE day_close END - prev_close AS change, prev_close, basis FROM b),
f AS (SELECT ticker, last_price, change, CASE WHEN prev_close <> 0 THEN change / prev_close END AS change_pct, CASE WHEN change IS NOT NULL THEN basis END AS change_basis FROM c)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    day = F.lit("2026-03-02 05:00:00").cast("timestamp")
    return market.change_columns(c.select(
        F.col("c_name").alias("ticker"), F.col("c_acctbal").alias("last_price"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2026-03-02 15:00:00")).otherwise(F.lit("2026-02-27 15:00:00")).cast("timestamp").alias("last_t"),
        F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal") + 1).alias("day_close"), F.when(F.col("c_custkey") % 5 > 0, day).alias("day_t"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey").cast("double")).alias("prev_close"),
    ))


@query("market_snapshots", f"WITH {SNAPSHOTS} SELECT ticker, round(change, 6) AS change, round(change_pct, 8) AS change_pct, change_basis FROM f")
def market_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).select("ticker", F.round("change", 6).alias("change"), F.round("change_pct", 8).alias("change_pct"), "change_basis")


@query(
    "market_movers",
    f"""WITH {SNAPSHOTS}, m AS (SELECT *, CASE WHEN change_pct > 0 THEN 'gainer' ELSE 'loser' END AS direction FROM f WHERE change_pct <> 0 AND last_price >= 100 AND ticker NOT LIKE '%7')
SELECT direction, rank, ticker FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY CASE WHEN direction = 'gainer' THEN -change_pct ELSE change_pct END, ticker) AS rank FROM m) WHERE rank <= 10""",
)
def market_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market.movers(_snapshots(spark, sf_dir).withColumn("price", F.col("last_price")), 10, 100.0, exclude="7$")
    return out.select("direction", F.col("rank").cast("long").alias("rank"), "ticker")


@query(
    "market_most_active",
    f"""WITH {SNAPSHOTS}, r AS (SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS ticker, sum(o_totalprice) AS volume FROM orders GROUP BY ALL)
SELECT ticker, round(volume, 2) AS volume, last_price AS price, change_basis, rank FROM (SELECT r.*, f.last_price, f.change_basis, row_number() OVER (ORDER BY volume DESC, r.ticker) AS rank FROM r LEFT JOIN f ON f.ticker = r.ticker WHERE f.last_price >= 50) WHERE rank <= 15""",
)
def market_most_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    ranking = o.groupBy(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("ticker")).agg(F.sum("o_totalprice").alias("volume"))
    out = market.most_active(ranking, _snapshots(spark, sf_dir), top=15, least_price=50.0)
    return out.select("ticker", F.round("volume", 2).alias("volume"), "price", "change_basis", F.col("rank").cast("long").alias("rank"))


DAYS = "SELECT DISTINCT ts::DATE AS date FROM events"


@query("market_calendar", f"SELECT date, timezone('UTC', timezone('America/New_York', date::TIMESTAMP + INTERVAL '9 hours 30 minutes')) AS open, timezone('UTC', timezone('America/New_York', date::TIMESTAMP + INTERVAL '16 hours')) AS close FROM ({DAYS})")
def market_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _events(spark, sf_dir).select(F.to_date("ts").alias("date")).distinct()
    return market.sessions(days.withColumn("open", F.lit("09:30")).withColumn("close", F.lit("1600")))


@query(
    "market_clock",
    f"""WITH d AS (SELECT date::TIMESTAMP + INTERVAL '14 hours 30 minutes' AS open, date::TIMESTAMP + INTERVAL '21 hours' AS close FROM ({DAYS}))
SELECT TIMESTAMP '2024-01-10 15:00:00' AS t, bool_or(open <= TIMESTAMP '2024-01-10 15:00:00' AND TIMESTAMP '2024-01-10 15:00:00' < close) AS is_open, min(open) FILTER (WHERE open > TIMESTAMP '2024-01-10 15:00:00') AS next_open,
  min(close) FILTER (WHERE close > TIMESTAMP '2024-01-10 15:00:00') AS next_close FROM d""",
)
def market_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.clock(market_calendar(spark, sf_dir), "2024-01-10 15:00:00")


@query("code_lists", "SELECT n_nationkey::VARCHAR AS code, n_name AS name FROM nation")
def code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    entries = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.col("n_name")))).alias("m"))
    return market.codes(entries, "m")


@query(
    "option_chain",
    """SELECT p_partkey::VARCHAR AS occ_symbol, p_size::DOUBLE AS strike, CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 2 END AS open_interest, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'not_found' ELSE 'not_reported' END END AS why
FROM part WHERE p_partkey % 4 <> 3 AND p_size BETWEEN 10 AND 30""",
)
def option_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    sym = F.col("p_partkey").cast("string").alias("occ_symbol")
    chain = p.select(sym, F.col("p_size").cast("double").alias("strike"), F.when(F.col("p_partkey") % 4 == 3, "put").otherwise("call").alias("option_type"), F.lit("X").alias("root"), F.lit("2026-01-16").cast("date").alias("expiration_date"))
    contracts = p.filter("p_partkey % 3 > 0 OR p_partkey % 2 > 0").select(sym, F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") * 2).alias("open_interest"), F.lit("2026-01-15").cast("date").alias("open_interest_date"))
    out = market.with_open_interest(market.option_filters(chain, "call", (10.0, 30.0), (None, "2026-12-31"), "X"), contracts)
    return out.select("occ_symbol", "strike", "open_interest", F.try_element_at("absent", F.lit("open_interest")).alias("why"))


# --- Windows of requests and bars at their edges -------------------------------------------------------

NOW = datetime(2024, 1, 20, 12, tzinfo=UTC)


@query("window_rows", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-13 05:00:00'")
def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four days before an end that is a whole day in New York; bars of a day begin at a midnight."""
    span = windows.resolve(NOW, end="2024-01-12", lookback="P4D", timeframe="1d", zone="America/New_York")
    return span.rows(_events(spark, sf_dir), "ts").select("event_id").filter(F.lit(span.start.day == 9)).unionByName(
        windows.resolve(NOW, start="2024-01-08", end="2024-01-08T23:59:59.999999Z").rows(_events(spark, sf_dir), "ts").select("event_id")
    )


@query("window_lag", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-19 11:45:00' AND ts <= TIMESTAMP '2024-01-20 11:45:00'")
def window_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day back from the newest data of a feed that lags by a quarter of an hour."""
    return windows.resolve(NOW, end="2025-01-01", lag="PT15M").rows(_events(spark, sf_dir), "ts").select("event_id")


EDGE = """d AS (SELECT event_type AS ticker, date_trunc('day', ts) AS t, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 6) AS volume FROM events GROUP BY ALL),
w AS (SELECT ticker, date_trunc('week', t) AS t, arg_min(open, t) AS open, max(high) AS high, min(low) AS low, arg_max(close, t) AS close, round(sum(volume), 4) AS volume FROM d GROUP BY ALL),
part AS (SELECT ticker, TIMESTAMP '2024-01-15' AS t, arg_min(open, t) AS open, max(high) AS high, min(low) AS low, arg_max(close, t) AS close, round(sum(volume), 4) AS volume FROM d WHERE t >= TIMESTAMP '2024-01-15' AND t < TIMESTAMP '2024-01-17' GROUP BY ticker)"""


@query(
    "bar_edges",
    f"""WITH {EDGE} SELECT *, NULL::VARCHAR AS edge FROM w WHERE t < TIMESTAMP '2024-01-15' UNION ALL SELECT *, CASE WHEN ticker = 'error' THEN NULL ELSE 'rebuilt' END FROM part WHERE ticker <> 'error'
UNION ALL SELECT *, NULL FROM w WHERE t = TIMESTAMP '2024-01-15' AND ticker = 'error'""",
)
def bar_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars to an end on a Wednesday: rebuilt from the days before it, but where nothing trades after the end."""
    d = daily_bars(spark, sf_dir).withColumnRenamed("series", "ticker").drop("n")
    w = an.resample_bars(d.withColumn("timeframe", F.lit("1d")), "1w", "t", "ticker").select("ticker", "t", "open", "high", "low", "close", F.round("volume", 4).alias("volume"))
    w = w.filter("t <= timestamp '2024-01-15'")
    span = windows.resolve(datetime(2024, 3, 1, tzinfo=UTC), start="2024-01-01", end="2024-01-17T12:00:00Z")
    ticks = _events(spark, sf_dir).select(F.col("event_type").alias("ticker"), F.col("ts").alias("t")).filter("ticker <> 'error'")
    out = windows.cap_last_bars(w, span, "1w", ticks, d, zone="UTC")
    return out.bars.join(out.touched, ["ticker", "t"], "left").select("ticker", "t", "open", "high", "low", "close", F.round("volume", 4).alias("volume"), "edge")


@query(
    "bar_bounds",
    """SELECT event_id, date_trunc('week', ts) AS w, date_trunc('week', ts) + INTERVAL 7 DAY AS w2, make_timestamp(year(ts), 1, 1, 0, 0, 0.0) AS q, make_timestamp(year(ts), 4, 1, 0, 0, 0.0) AS q2,
  to_timestamp(floor(epoch(ts) / 14400) * 14400)::TIMESTAMP AS h FROM events""",
)
def bar_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    w, q = windows.bar_start(t, "1w"), windows.bar_start(t, "3mo")
    return _events(spark, sf_dir).select("event_id", w.alias("w"), windows.bar_end(w, "1w").alias("w2"), q.alias("q"), windows.bar_end(q, "3mo").alias("q2"), windows.bar_start(t, "4h").alias("h"))


# --- Rules of the dataset reader ---------------------------------------------------------------------


def _stand_in(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Versions in the tool's columns: keys and text from event numbers, days as times, knowledge after a lag."""
    spec = TOOLS[name].spec
    e = load(spark, sf_dir, "events")
    cols = {"knowledge_time": F.timestamp_micros(F.unix_micros("ts") + F.pmod(F.col("event_id") * 7919, F.lit(200_000)) * 1_000_000)}
    if spec.time:
        cols[spec.time] = F.date_trunc("day", "ts")
    for i, c in enumerate(dict.fromkeys([*spec.key, *(c for c, _ in spec.order), *spec.search])):
        cols.setdefault(c, F.concat(F.lit("k"), (F.col("event_id") % (i + 2)).cast("string")))
    for c in spec.percents or ("value",):
        cols[c] = F.col("value")
    return e.select(*(c.alias(n) for n, c in cols.items()), "event_id")


def _stand_in_sql(name: str) -> str:
    spec = TOOLS[name].spec
    cols = {"knowledge_time": "ts + to_seconds((event_id * 7919) % 200000)"}
    if spec.time:
        cols[spec.time] = "date_trunc('day', ts)"
    for i, c in enumerate(dict.fromkeys([*spec.key, *(c for c, _ in spec.order), *spec.search])):
        cols.setdefault(c, f"'k' || (event_id % {i + 2})")
    for c in spec.percents or ("value",):
        cols[c] = "round(value / 100, 10)" if spec.percents else "value"
    made = ", ".join(f'{x} AS "{c}"' for c, x in cols.items())
    where = ["knowledge_time <= TIMESTAMP '2024-01-25 12:00:00'"]
    if spec.time:
        where += [f"\"{spec.time}\" >= TIMESTAMP '2024-01-05'", f"\"{spec.time}\" <= TIMESTAMP '2024-01-20'"]
    first = next((c for c in spec.key if c != spec.time), None)
    if first:
        where.append(f"\"{first}\" IN ('k0', 'k1')")
    keys = ", ".join(f'"{k}"' for k in spec.key)
    return f"SELECT * FROM (SELECT {made}, event_id FROM events) WHERE {' AND '.join(where)} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY knowledge_time DESC) = 1"


def _tool(name: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = TOOLS[name].spec
        first = next((c for c in spec.key if c != spec.time), None)
        cut = {"start": "2024-01-05", "end": "2024-01-20"} if spec.time else {}
        return read_tool(_stand_in(spark, sf_dir, name), name, "2024-01-25 12:00:00", **cut, **({first: ["k0", "k1"]} if first else {})).rows

    return f


for _name in TOOLS:
    query(f"tool_{_name}", _stand_in_sql(_name))(_tool(_name))


@query("dataset_all_versions", f"WITH {VERSIONS} SELECT user_id, day, knowledge_time, value, event_id FROM v WHERE knowledge_time <= TIMESTAMP '2024-01-15 12:00:00' AND user_id IN (3, 4, 5)")
def dataset_all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ds.Dataset(("user_id", "day"), "day", (("user_id", "asc"), ("day", "desc")))
    return ds.read_dataset(versions(spark, sf_dir), spec, "2024-01-15 12:00:00", "all", user_id=[3, 4, 5]).rows


@query("dataset_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red%' ORDER BY p_name, p_partkey LIMIT 40")
def dataset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text search whatever the case, in a given order, cut at the row cap."""
    spec = ds.Dataset(("p_partkey",), None, (("p_name", "asc"), ("p_partkey", "asc")), search=("p_name",))
    got = ds.read_dataset(load(spark, sf_dir, "part").select("p_partkey", "p_name"), spec, q="RED", most=40)
    return got.capped()


@query("dataset_ranks", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderkey LIMIT 4000")
def dataset_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return o.orderBy(ds.ranked("o_orderpriority", ("3-MEDIUM", "1-URGENT")).asc_nulls_last(), "o_orderkey").limit(4000)


@query("limit_groups", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY max(o_totalprice) DESC, o_custkey LIMIT 12)")
def limit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.limit_groups(load(spark, sf_dir, "orders"), "o_custkey", F.col("o_totalprice"), 12).select("o_orderkey", "o_custkey")


HOLDINGS = """h AS (SELECT o_custkey % 20 AS filer, date_trunc('quarter', o_orderdate) AS period, o_orderdate AS filed, o_orderkey AS accession,
  CASE o_orderkey % 9 WHEN 0 THEN 'RESTATEMENT' WHEN 1 THEN 'New Holdings' WHEN 2 THEN NULL ELSE '' END AS kind FROM orders)"""


@query(
    "standing_portfolio",
    f"""WITH {HOLDINGS}, l AS (SELECT filer, period, max((filed, accession)) AS m FROM h WHERE kind = 'RESTATEMENT' GROUP BY ALL)
SELECT h.accession FROM h LEFT JOIN l USING (filer, period) WHERE m IS NULL OR accession = m[2] OR (upper(kind) = 'NEW HOLDINGS' AND (filed, accession) > m)""",
)
def standing_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey") % 9
    h = o.select(
        (F.col("o_custkey") % 20).alias("filer"), F.date_trunc("quarter", "o_orderdate").alias("period"), F.col("o_orderdate").alias("filed"), F.col("o_orderkey").alias("accession"),
        F.when(k == 0, "RESTATEMENT").when(k == 1, "New Holdings").when(k == 2, F.lit(None)).otherwise("").alias("kind"),
    )
    return ds.standing_portfolio(h, "period", "filed", "accession", "kind", ("filer",)).select("accession")


@query("newest_report", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY rank() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC) = 1")
def newest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.newest_report(load(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_shipdate", "l_orderkey").select("l_orderkey", "l_linenumber")


@query(
    "security_class",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'TIPS' WHEN o_orderstatus = 'O' AND o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 THEN 'FRN' WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'CMB'
  ELSE CASE o_orderstatus WHEN 'O' THEN 'Note' WHEN 'F' THEN 'Bill' ELSE 'Bond' END END AS class FROM orders""",
)
def security_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, st = F.col("o_orderkey"), F.col("o_orderstatus")
    kind = F.when(st == "O", "Note").when(st == "F", "Bill").otherwise("Bond")
    term = F.when(k % 4 == 0, "42-Day").otherwise("13-Week")
    out = ds.security_class(kind, term, k % 5 == 0, F.when(k % 3 > 0, 1.0), F.when(k % 2 > 0, 1.0))
    return load(spark, sf_dir, "orders").select("o_orderkey", out.alias("class"))


@query(
    "merged_publications",
    "SELECT coalesce(a.k, b.k) AS k, coalesce(a.x, b.x) AS x, a.y, b.z FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS x, c_name AS y FROM customer WHERE c_custkey % 3 > 0) a FULL JOIN (SELECT c_custkey AS k, -c_acctbal AS x, c_mktsegment AS z FROM customer WHERE c_custkey % 4 > 0) b ON a.k = b.k",
)
def merged_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    a = c.filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("x"), F.col("c_name").alias("y"))
    b = c.filter("c_custkey % 4 > 0").select(F.col("c_custkey").alias("k"), (-F.col("c_acctbal")).alias("x"), F.col("c_mktsegment").alias("z"))
    return ds.merged_publications(a, b, ["k"])


@query("published_union", "SELECT DISTINCT 'stocks' AS market, o_orderdate::DATE AS day FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT DISTINCT 'bonds', o_orderdate::DATE FROM orders WHERE o_orderkey % 3 = 0")
def published_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return ds.published_union(o.filter("o_orderkey % 2 = 0").select("day"), o.filter("o_orderkey % 3 = 0").select("day"), key=["day"], names=("stocks", "bonds"))


@query("frame_ranks", "SELECT c_custkey, rank() OVER w AS rank, round(percent_rank() OVER w, 8) AS percentile FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 100) DESC)")
def frame_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").withColumn("v", F.floor(F.col("c_acctbal") / 100))
    return ds.frame_ranks(c, "v", ["c_nationkey"]).select("c_custkey", F.col("rank").cast("long").alias("rank"), F.round("percentile", 8).alias("percentile"))


@query(
    "yearly_growth",
    """WITH m AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL)
SELECT a.p, a.month, a.v, round((a.v - b.v) / abs(b.v), 8) AS growth FROM m a LEFT JOIN m b ON a.p = b.p AND a.month = (b.month + INTERVAL 12 MONTH)::DATE""",
)
def yearly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return ds.growth(o, ["p"], "month", "v").withColumn("growth", F.round("growth", 8))


# --- Long series: the same rows from pieces ------------------------------------------------------------


def _cut(spark: SparkSession, sf_dir: str) -> Series:
    s = daily(spark, sf_dir)
    return Series(s.df, s.time, s.series, s.value, s.label, spread="1w")


query("returns_in_pieces", SQL["returns_simple"])(lambda spark, sf_dir: rounded(an.returns(_cut(spark, sf_dir))).drop("period", "kind"))
query("drawdown_in_pieces", SQL["drawdown_series"])(lambda spark, sf_dir: an.drawdown_series(_cut(spark, sf_dir)).withColumn("drawdown", F.round("drawdown", 8)))
query("volatility_in_pieces", SQL["volatility_rolling"])(lambda spark, sf_dir: rounded(an.volatility(_cut(spark, sf_dir), 5, periods=252)))


def _asof(direction: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = sides(spark, sf_dir)
        return asof_join(left, right, "ts", "seen", [("user_id", "user_id")], direction, spread="1d")

    return f


query("asof_in_pieces", SQL["asof_backward"])(_asof("backward"))
query("asof_forward_in_pieces", SQL["asof_forward"])(_asof("forward"))

ALONE = "l AS (SELECT event_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT ts AS seen, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)"


@query("asof_without_key", f"WITH {ALONE} SELECT event_id, l.ts, r.seen AS matched_t, r.value FROM l ASOF LEFT JOIN r ON l.ts > r.seen")
def asof_without_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return asof_join(left.drop("user_id"), right.drop("user_id"), "ts", "seen", strict=True, spread="4h")


@query("returns_without_series", "WITH d AS (SELECT date_trunc('hour', ts) AS t, avg(value) AS v FROM events GROUP BY 1) SELECT '_all' AS series, t, round(ret, 8) AS ret FROM (SELECT t, v / lag(v) OVER (ORDER BY t) - 1 AS ret FROM d) WHERE ret IS NOT NULL")
def returns_without_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("t")).agg(F.avg("value").alias("v"))
    return rounded(an.returns(Series(d, "t", None, "v", spread="1d"))).select("series", "t", "ret")


# --- Further analytics ---------------------------------------------------------------------------



@query(
    "correlation_spearman",
    f"""WITH {DAILY}, p AS (SELECT a.s AS x, b.s AS y, a.ts, a.v AS v, b.v AS u FROM daily a JOIN daily b USING (ts)),
k AS (SELECT x, y, rank() OVER (PARTITION BY x, y ORDER BY v) + (count(*) OVER (PARTITION BY x, y, v) - 1) / 2.0 AS v, rank() OVER (PARTITION BY x, y ORDER BY u) + (count(*) OVER (PARTITION BY x, y, u) - 1) / 2.0 AS u FROM p)
SELECT x AS series_a, y AS series_b, count(*) AS n_obs, round(CASE WHEN x = y THEN 1.0 ELSE corr(v, u) END, 8) AS correlation FROM k GROUP BY x, y""",
)
def correlation_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(an.correlation(daily(spark, sf_dir), "levels", method="spearman"))


@query("volatility_of_pairs", f"WITH {DAILY}, r AS (SELECT s || '/USD' AS s, ts, ln(v / lag(v) OVER (PARTITION BY s ORDER BY ts)) AS r FROM daily) SELECT s AS series, round(stddev_samp(r) * sqrt(365), 8) AS volatility FROM r WHERE r IS NOT NULL GROUP BY s HAVING count(*) >= 2")
def volatility_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default of a market that trades every day: series named BASE/QUOTE, bars of a day."""
    s = daily(spark, sf_dir)
    df = s.df.select(F.concat("s", F.lit("/USD")).alias("s"), "ts", "v", F.lit("1d").alias("timeframe"))
    return rounded(an.volatility(Series(df, "ts", "s", "v"), "all")).select("series", "volatility")


@query("volatility_of_stocks", f"WITH {DAILY}, r AS (SELECT s, ts, v / lag(v) OVER (PARTITION BY s ORDER BY ts) - 1 AS r FROM daily) SELECT s AS series, round(stddev_samp(r) * sqrt(252), 8) AS volatility FROM r WHERE r IS NOT NULL GROUP BY s HAVING count(*) >= 2")
def volatility_of_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = daily(spark, sf_dir)
    df = s.df.withColumn("timeframe", F.lit("1d")).withColumn("asset_class", F.lit("us_equity"))
    return rounded(an.volatility(Series(df, "ts", "s", "v"), "all", "simple")).select("series", "volatility")


@query("volatility_of_returns", f"WITH {DAILY}, r AS (SELECT s, ts, v AS r FROM daily) SELECT s AS series, round(stddev_samp(r) * 2, 8) AS volatility, count(*) AS n_obs FROM r GROUP BY s HAVING count(*) >= 2")
def volatility_of_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(an.volatility(daily(spark, sf_dir), "all", periods=4, as_returns=True)).select("series", "volatility", "n_obs")


@query(
    "beta_gaps",
    f"""WITH {DAILY}, a AS (SELECT s, ts, row_number() OVER (PARTITION BY s ORDER BY ts) AS k FROM daily WHERE s <> 'click' AND (s <> 'view' OR day(ts) % 5 > 0)), b AS (SELECT ts, row_number() OVER (ORDER BY ts) AS j FROM daily WHERE s = 'click' AND day(ts) % 7 > 0),
j AS (SELECT a.s, k - lag(k) OVER w AS dk, j - lag(j) OVER w AS dj FROM a JOIN b USING (ts) WINDOW w AS (PARTITION BY a.s ORDER BY a.ts)) SELECT s AS series, count(*) FILTER (WHERE dk > 1 OR dj > 1) AS gaps FROM j GROUP BY s""",
)
def beta_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = daily(spark, sf_dir)
    df = s.df.filter("(s <> 'view' OR day(ts) % 5 > 0) AND (s <> 'click' OR day(ts) % 7 > 0)")
    return an.gap_counts(*an.split_benchmark(Series(df, "ts", "s", "v"), "click"))


@query("beta_weekly_log", f"""WITH {DAILY}, w AS (SELECT s, date_trunc('week', ts) AS ts, arg_max(v, ts) AS v FROM daily GROUP BY ALL),
j AS (SELECT a.s, ln(a.v / lag(a.v) OVER w) AS a, ln(b.v / lag(b.v) OVER w) AS b FROM w a JOIN w b ON a.ts = b.ts AND b.s = 'click' WHERE a.s <> 'click' WINDOW w AS (PARTITION BY a.s ORDER BY a.ts))
SELECT s AS series, round(covar_samp(a, b) / var_samp(b), 8) AS beta, count(*) AS n_obs FROM j WHERE a IS NOT NULL GROUP BY s""")
def beta_weekly_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(an.beta(*an.split_benchmark(daily(spark, sf_dir), "click"), "log", "1w", 2)).select("series", "beta", "n_obs")


@query("resample_passed_bars", SQL["resample_weekly_bars"].replace(", sum(n)::BIGINT AS trade_count,\n  round(sum((high + low) / 2 * volume) / sum(volume), 6) AS vwap, count(*) AS bars", ""))
def resample_passed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that a query handed on are resampled by the bar rules, as their lineage says what they are."""
    d = daily_bars(spark, sf_dir).drop("n").withColumn("timeframe", F.lit("1d"))
    d.createOrReplaceTempView("passed_bars")
    out = spark.sql("SELECT series, t, open, high, low, close, volume, timeframe FROM passed_bars WHERE volume IS NOT NULL")
    rule, _ = of_query(out, {"passed_bars": Known(d, "t", RowsOf("Bar", span="timeframe"))})
    return an.resample_any(out, "1w", rule, series="series").select("series", "t", "open", "high", "low", "close", F.round("volume", 4).alias("volume"))


for _agg, _sql in (("first", "arg_min(value, (ts, event_id))"), ("sum", "round(sum(value), 6)"), ("min", "min(value)"), ("max", "max(value)")):

    def _resampled(spark: SparkSession, sf_dir: str, agg: str = _agg) -> DataFrame:
        e = _events(spark, sf_dir).select("event_type", "ts", "value", "event_id")
        return rounded(an.resample(e, "4h", agg, "ts", "event_type", values=["value"], order="event_id").drop("timeframe"), 6)

    query(f"resample_{_agg}_4h", f"SELECT event_type, to_timestamp(floor(epoch(ts - TIMESTAMP '2000-01-03') / 14400) * 14400 + epoch(TIMESTAMP '2000-01-03'))::TIMESTAMP AS ts, {_sql} AS value FROM events GROUP BY 1, 2")(_resampled)


# --- Point in time ---------------------------------------------------------------------------------

CLICKS = "l AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'click')"


@query(
    "align_stale",
    f"""WITH {CLICKS}, {VERSIONS}, k AS (SELECT *, greatest(day, knowledge_time) AS rk FROM v),
d AS (SELECT * FROM (SELECT *, max(day) OVER (PARTITION BY user_id ORDER BY rk RANGE UNBOUNDED PRECEDING) AS newest FROM k) WHERE day >= newest QUALIFY row_number() OVER (PARTITION BY user_id, rk ORDER BY day DESC) = 1),
j AS (SELECT l.event_id, l.ts, l.user_id, d.day AS matched_t FROM l ASOF LEFT JOIN d ON l.user_id = d.user_id AND l.ts >= d.rk), e AS (SELECT DISTINCT user_id, day FROM v)
SELECT j.event_id, j.matched_t, e.day AS newest_t FROM j ASOF LEFT JOIN e ON j.user_id = e.user_id AND j.ts >= e.day WHERE e.day > j.matched_t""",
)
def align_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches beside which a newer value was dated already, but not known yet."""
    left, _ = sides(spark, sf_dir)
    a = align(left, versions(spark, sf_dir), "ts", "day", [("user_id", "user_id")], right_columns=["value"], clock=Clock(column="knowledge_time"))
    return a.stale().select("event_id", "matched_t", "newest_t")


@query(
    "align_revised",
    f"""WITH {VERSIONS}, o AS (SELECT user_id, day, max(greatest(day, knowledge_time)) AS k FROM v GROUP BY ALL), n AS (SELECT *, min(k) OVER (PARTITION BY user_id ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nx FROM o)
SELECT count(*) FILTER (WHERE k > nx) AS revised, count(*) AS total FROM n""",
)
def align_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = sides(spark, sf_dir)
    v = versions(spark, sf_dir).groupBy("user_id", "day").agg(F.max("knowledge_time").alias("knowledge_time"), F.max("value").alias("value"))
    a = align(left, v, "ts", "day", [("user_id", "user_id")], clock=Clock(column="knowledge_time"))
    return spark.createDataFrame([a.revised()], "revised long, total long")


@query(
    "align_look_ahead",
    f"""WITH {CLICKS}, {VERSIONS}, o AS (SELECT user_id, day, max(greatest(day, knowledge_time)) AS k, arg_max(value, knowledge_time) AS value FROM v GROUP BY ALL),
j AS (SELECT l.ts, o.k FROM l ASOF LEFT JOIN o ON l.user_id = o.user_id AND l.ts >= o.day) SELECT count(*) FILTER (WHERE k > ts) AS ahead, count(*) FILTER (WHERE k IS NULL) AS unmatched FROM j""",
)
def align_look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched on time alone: how many rows see what wasn't known yet, and how many see nothing."""
    left, _ = sides(spark, sf_dir)
    v = versions(spark, sf_dir).groupBy("user_id", "day").agg(F.max("knowledge_time").alias("knowledge_time"), F.max_by("value", "knowledge_time").alias("value"))
    a = align(left, v, "ts", "day", [("user_id", "user_id")], match_on="time", clock=Clock(column="knowledge_time"))
    return spark.createDataFrame([(a.look_ahead("ts"), a.unmatched())], "ahead long, unmatched long")


@query(
    "align_bars",
    f"""WITH {CLICKS}, b AS (SELECT user_id, date_trunc('day', ts) AS t, max(value) AS high, date_trunc('day', ts) + INTERVAL 1 DAY + INTERVAL 60 SECOND AS k FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT l.event_id, l.ts, l.user_id, b.t AS matched_t, b.high FROM l ASOF LEFT JOIN b ON l.user_id = b.user_id AND l.ts >= b.k""",
)
def align_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars are known at their end, and a minute later if the source lags."""
    left, _ = sides(spark, sf_dir)
    e = _events(spark, sf_dir).filter("event_type = 'view'")
    bars = e.groupBy("user_id", F.date_trunc("day", "ts").alias("t")).agg(F.max("value").alias("high"))
    return align(left, bars, "ts", "t", [("user_id", "user_id")], clock=Clock(span="1d", lag_seconds=60)).df


@query(
    "bucket_lag",
    f"WITH {VERSIONS} SELECT '1w' AS span, greatest(0, ceil(max(epoch_us(greatest(day, knowledge_time)) - epoch_us(date_trunc('week', day) + INTERVAL 7 DAY)) / 1e6))::BIGINT AS lag FROM v",
)
def bucket_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much later than a bucket's end its rows may have become known."""
    rule = bucketed([Known(versions(spark, sf_dir), "day", RowsOf("SeriesPoint", clock="knowledge_time"))], "1w")
    return spark.createDataFrame([(rule.span, rule.lag_seconds)], "span string, lag long")


def _two(spark: SparkSession, sf_dir: str) -> dict[str, Known]:
    v = versions(spark, sf_dir)
    v = v.select("user_id", "day", F.col("knowledge_time").alias("knowledge_time", metadata={"role": "available"}), "value")
    e = _events(spark, sf_dir).select("event_id", "user_id", F.col("ts").alias("day"), "value")
    out = {"pit_v": Known(v, "day", RowsOf("SeriesPoint", clock="knowledge_time")), "pit_e": Known(e, "day", RowsOf("Trade"))}
    for name, k in out.items():
        k.df.createOrReplaceTempView(name)
    return out


@query(
    "lineage_columns",
    "SELECT * FROM (VALUES ('who', 'pit_v.user_id'), ('day', 'pit_v.day'), ('top', 'pit_e.value+pit_v.value'), ('more', ''), ('known', 'pit_v.knowledge_time')) t(name, sources)",
)
def lineage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source columns an answer's columns pass through."""
    _two(spark, sf_dir)
    got = lineage(spark.sql("SELECT v.user_id AS who, v.day AS day, greatest(v.value, e.value) AS top, v.value + 1 AS more, max(v.knowledge_time) AS known FROM pit_v v JOIN pit_e e ON v.day = e.day GROUP BY ALL"
                            .replace("max(v.knowledge_time) AS known", "v.knowledge_time AS known").replace(" GROUP BY ALL", "")))
    names = {"v": "pit_v", "e": "pit_e"}
    rows = [(c, "+".join(sorted(f"{names.get(r, r)}.{x}" for r, x in s))) for c, s in got.columns.items()]
    return spark.createDataFrame(rows, "name string, sources string")


CASES = {
    "passed": "SELECT user_id, day, knowledge_time, value FROM pit_v WHERE value > 1",
    "clock left out": "SELECT user_id, day, value FROM pit_v",
    "computed clock": "SELECT user_id, day, knowledge_time + INTERVAL 1 DAY AS knowledge_time FROM pit_v",
    "grouped": "SELECT user_id, max(day) AS day, max(knowledge_time) AS knowledge_time FROM pit_v GROUP BY user_id",
    "window": "SELECT user_id, day, knowledge_time, lag(value) OVER (PARTITION BY user_id ORDER BY day) AS before FROM pit_v",
    "subquery": "SELECT user_id, day, knowledge_time FROM pit_v WHERE value > (SELECT avg(value) FROM pit_e)",
    "joined": "SELECT v.user_id, v.day, v.knowledge_time, e.value FROM pit_v v JOIN pit_e e ON v.day = e.day AND v.user_id = e.user_id",
}


@query(
    "rows_of_queries",
    """SELECT * FROM (VALUES ('passed', true, 0), ('clock left out', false, 1), ('computed clock', false, 1), ('grouped', false, 1), ('window', false, 1), ('subquery', false, 1), ('joined', true, 0)) t(name, shown, notes)""",
)
def rows_of_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer's rows still show when they became known, and how many clocks were lost."""
    inputs = _two(spark, sf_dir)
    rows = []
    for name, sql in CASES.items():
        out = spark.sql(sql)
        named = {r: inputs[{"v": "pit_v", "e": "pit_e"}.get(r, r)] for r in lineage(out).relations if {"v": "pit_v", "e": "pit_e"}.get(r, r) in inputs}
        rule, _ = of_query(out, named)
        rows.append((name, bool(rule and rule.shown), len(lost_clocks(out, named))))
    return spark.createDataFrame(rows, "name string, shown boolean, notes int")


# --- Streams -----------------------------------------------------------------------------------------


@query("stream_resample", SQL["resample_daily_bars"])
def stream_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bars from a stream of the same table, its last state written batch by batch."""
    from vantidal.session import delete_on_exit
    from vantidal.streaming.resample import resample_stream

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    bars = resample_stream(ticks, "1d", "ts", "event_type", "value", "event_id", "0 seconds")
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    delete_on_exit(spark, root)
    writer = bars.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/bars")).start().awaitTermination()
    return spark.read.parquet(f"{root}/bars").withColumn("volume", F.round("volume", 6))
