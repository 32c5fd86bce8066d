"""Registered queries of the record readers: driver tables written as the records that a source sends, read back and used."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.catalog import query
from vantidal.session import delete_on_exit, load, shared_dir
from vantidal.sources import records as rec


def _landed(spark: SparkSession, df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """The rows as JSON (a record a line; under a root all in one object) and read back in the shape's model."""
    path = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    df.write.json(path)
    return rec.read_records(spark, path, name, lines=True).rows


CUSTOMERS = "SELECT c_name AS ticker, CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'inactive' END AS status, (ARRAY['XA', 'XB', 'XC'])[c_custkey % 3 + 1] AS exchange, c_custkey FROM customer"


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select(
        F.col("c_name").alias("symbol"), F.lit("us_equity").alias("class"), F.when(F.col("c_custkey") % 2 == 0, "active").otherwise("inactive").alias("status"),
        F.get(F.array(*(F.lit(x) for x in ("XA", "XB", "XC"))), (F.col("c_custkey") % 3).cast("int")).alias("exchange"), (F.col("c_custkey") % 5 == 0).alias("tradable"),
        F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("has_options"))).otherwise(F.array().cast("array<string>")).alias("attributes"), F.lit("0.000000001").alias("min_order_size"),
    )


@query("records_assets", f"SELECT ticker, exchange, c_custkey % 5 = 0 AS tradable, 0.000000001::DECIMAL(38,12) AS least FROM ({CUSTOMERS}) WHERE status = 'active' AND exchange = 'XB' AND c_custkey % 4 = 0")
def records_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rec.assets(_landed(spark, _assets(spark, sf_dir), "Asset"), "active", "us_equity", "XB", ["has_options"])
    return out.select("ticker", "exchange", "tradable", F.col("min_order_size").alias("least"))


@query("records_one_asset", f"SELECT ticker, status FROM ({CUSTOMERS}) WHERE ticker = 'Customer#000000003'")
def records_one_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.one(_landed(spark, _assets(spark, sf_dir), "Asset"), "ticker", "Customer#000000003").select("ticker", "status")


@query(
    "records_contracts",
    "SELECT p_partkey::VARCHAR AS occ_symbol, p_size::DOUBLE AS strike, DATE '2026-01-01' + (p_partkey % 300)::INT AS expiration_date FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_size >= 20 AND p_partkey % 300 >= 59",
)
def records_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey")
    raw = p.select(
        k.cast("string").alias("symbol"), F.lit("ABC").alias("underlying_symbol"), F.lit("ABC").alias("root_symbol"), F.when(k % 2 == 0, "active").otherwise("inactive").alias("status"),
        F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int")).alias("expiration_date"), F.col("p_size").cast("string").alias("strike_price"), F.when(k % 3 == 0, "call").otherwise("put").alias("type"), F.lit("american").alias("style"),
    )
    out = rec.contracts(_landed(spark, raw, "OptionContract"), "2026-03-01", "active", ["ABC"], "call", "american", "ABC", (20.0, None))
    return out.select("occ_symbol", "strike", "expiration_date")


@query(
    "records_corporate_actions",
    """SELECT 'cash_dividend' AS action_type, o_orderkey::VARCHAR AS action_id, round(o_totalprice / 100, 4) AS rate, NULL::DOUBLE AS old_rate, NULL::VARCHAR AS new_ticker, 'new_ticker,old_rate' AS absent FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'forward_split', o_orderkey::VARCHAR, NULL, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 END, NULL, CASE WHEN o_orderkey % 2 = 0 THEN 'new_ticker,rate' ELSE 'new_ticker,old_rate,rate' END FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'name_change', o_orderkey::VARCHAR, NULL, NULL, 'N' || o_custkey, 'old_rate,rate' FROM orders WHERE o_orderstatus = 'P'""",
)
def records_corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string").alias("action_id")
    kinds = {
        "cash_dividend": o.filter("o_orderstatus = 'O'").select(key, F.round(F.col("o_totalprice") / 100, 4).alias("rate")),
        "forward_split": o.filter("o_orderstatus = 'F'").select(key, F.when(F.col("o_orderkey") % 2 == 0, F.lit(1.0)).alias("old_rate")),
        "name_change": o.filter("o_orderstatus = 'P'").select(key, F.concat(F.lit("N"), "o_custkey").alias("new_ticker")),
    }
    out = rec.corporate_actions(kinds, {"action_id": "string", "rate": "double", "old_rate": "double", "new_ticker": "string"})
    return out.withColumn("absent", F.array_join(F.array_sort(F.map_keys("absent")), ","))


@query("records_announcements", "SELECT o_orderkey::VARCHAR AS announcement_id, o_orderdate::DATE AS ex_date, o_totalprice::DECIMAL(38,12) AS cash FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-01' AND o_custkey % 2 = 0")
def records_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    raw = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("ca_type"), F.when(F.col("o_custkey") % 2 == 0, "EVEN").otherwise("ODD").alias("initiating_symbol"), F.to_date("o_orderdate").alias("ex_date"),
        F.col("o_totalprice").cast("decimal(20,2)").alias("cash"),
    )
    return rec.announcements(_landed(spark, raw, "Announcement"), ["O", "P"], "1997-01-01", "1997-03-01", "EVEN").select("announcement_id", "ex_date", "cash")


@query(
    "records_news_search",
    """SELECT p_partkey::VARCHAR AS news_id FROM part WHERE (p_partkey % 5 = 0 OR p_partkey % 7 = 0) AND regexp_matches(lower(p_name), '(^|[^a-z0-9_])red([^a-z0-9_]|$)') AND p_partkey % 3 > 0""",
)
def records_news_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in headline or summary (here `red` and, behind an entity, `it's`), any of two tickers, articles with a text."""
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey")
    raw = p.select(
        k.cast("string").alias("id"), F.upper("p_name").alias("headline"), F.lit("It&#39;s new.").alias("summary"), F.when(k % 3 > 0, F.lit("text")).otherwise(F.lit(" ")).alias("content"),
        F.array_compact(F.array(F.when(k % 5 == 0, F.lit("FIVE")), F.when(k % 7 == 0, F.lit("SEVEN")), F.lit("ALL"))).alias("symbols"), F.date_format(F.timestamp_seconds(k), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )
    return rec.news_search(_landed(spark, raw, "NewsItem"), ["FIVE", "SEVEN"], "red it's", exclude_contentless=True).select("news_id")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("C"), F.col("o_custkey") % 10).alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit("limit").alias("type"),
        F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderstatus") == "P", "partially_filled").otherwise("new").alias("status"), F.lit("1.5").alias("qty"), F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("limit_price"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )


@query("records_orders", "SELECT o_orderkey::VARCHAR AS order_id, o_totalprice::DECIMAL(38,12) AS limit_price, o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 10 IN (3, 4) AND o_orderkey % 2 = 0 AND o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def records_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rec.orders(_landed(spark, _orders(spark, sf_dir), "Order"), "open", ["C3", "C4"], "buy", "1997-01-01", "1999-01-01")
    return out.select("order_id", "limit_price", "created_at")


@query("records_order_pages", "SELECT o_orderkey::VARCHAR AS order_id FROM orders ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 30 OFFSET 30")
def records_order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of thirty, from the last order of the first on."""
    o = rec.in_shape(_orders(spark, sf_dir), "Order").rows
    first = rec.page_after(o, "created_at", None, 30, "order_id").select("created_at", "order_id")
    last = first.orderBy("created_at", F.col("order_id").desc()).first()
    return rec.page_after(o, "created_at", last.order_id, 30, "order_id").select("order_id")


@query(
    "records_activities",
    """SELECT l_orderkey::VARCHAR || '-' || l_linenumber AS activity_id, 'trade' AS category, l_shipdate AS t, l_quantity::DECIMAL(38,12) AS qty, NULL::DECIMAL(38,12) AS net_amount FROM lineitem WHERE l_orderkey % 10 = 0
UNION ALL SELECT o_orderkey::VARCHAR, 'non_trade', date_trunc('day', o_orderdate), NULL, o_totalprice::DECIMAL(38,12) FROM orders WHERE o_orderkey % 10 = 0""",
)
def records_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = load(spark, sf_dir, "lineitem").filter("l_orderkey % 10 = 0"), load(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0")
    fills = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_shipdate").alias("transaction_time"), F.lit("X").alias("symbol"), F.lit("buy").alias("side"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    rest = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("DIV").alias("activity_type"), F.col("o_orderdate").alias("date"), F.lit(None).cast("string").alias("symbol"), F.col("o_totalprice").alias("net_amount"))
    return rec.activities(fills, rest).select("activity_id", "category", "t", "qty", "net_amount")


@query("records_positions", "SELECT c_name AS ticker, c_acctbal::DECIMAL(38,12) AS market_value, c_acctbal > 0 AS up FROM customer WHERE c_custkey % 2 = 0")
def records_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact decimals from text; records without a quantity are skipped."""
    c = load(spark, sf_dir, "customer")
    raw = c.select(
        F.col("c_name").alias("symbol"), F.lit("us_equity").alias("asset_class"), F.lit("long").alias("side"), F.when(F.col("c_custkey") % 2 == 0, F.lit("3.000000000001")).alias("qty"), F.lit("1").alias("avg_entry_price"),
        F.col("c_acctbal").cast("decimal(20,2)").cast("string").alias("market_value"),
    )
    return _landed(spark, raw, "Position").select("ticker", "market_value", (F.col("market_value") > 0).alias("up"))


@query("records_account", "SELECT s_suppkey::VARCHAR AS account_id, '*****' || right(s_name, 4) AS account_number_masked, s_acctbal::DECIMAL(38,12) AS cash FROM supplier")
def records_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    number = F.substring("s_name", -9, 9)
    money = F.col("s_acctbal").cast("decimal(20,2)").cast("string")
    raw = s.select(F.col("s_suppkey").cast("string").alias("id"), rec.masked(number).alias("account_number_masked"), F.lit("ACTIVE").alias("status"), F.lit("USD").alias("currency"), money.alias("cash"), money.alias("equity"), money.alias("buying_power"))
    return _landed(spark, raw, "Account").select("account_id", "account_number_masked", "cash")


@query("records_bonds", "SELECT p_partkey::VARCHAR AS isin, CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END AS bid_price, round(p_size / 100, 10) AS bid_ytm FROM part")
def records_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yields in percent as fractions; a price of 0 means that there is none."""
    p = load(spark, sf_dir, "part")
    raw = p.select(F.col("p_partkey").cast("string").alias("isin"), F.lit("2026-03-02T15:00:00.123456789Z").alias("t"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_retailprice")).otherwise(0.0).cast("string").alias("bp"), F.col("p_size").cast("string").alias("bytm"))
    return _landed(spark, raw, "BondQuote").select("isin", "bid_price", "bid_ytm")


@query("records_option_bars", "SELECT 'ABC260116C' || lpad((p_size * 1000)::VARCHAR, 8, '0') AS occ_symbol, 'ABC' AS underlying, DATE '2026-01-16' AS expiration_date, 'call' AS option_type, p_size::DOUBLE AS strike, p_retailprice AS close FROM part WHERE p_partkey % 2 = 0")
def records_option_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    good = F.concat(F.lit("abc   260116C"), F.lpad((F.col("p_size") * 1000).cast("string"), 8, "0"))
    raw = p.select(F.when(F.col("p_partkey") % 2 == 0, good).otherwise("no symbol").alias("symbol"), F.col("p_retailprice").alias("close"))
    return rec.option_rows(raw)


@query("records_watchlists", "SELECT n_regionkey::VARCHAR AS watchlist_id, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS tickers FROM nation GROUP BY n_regionkey")
def records_watchlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    raw = n.groupBy(F.col("n_regionkey").cast("string").alias("id")).agg(F.collect_list("n_name").alias("tickers"), F.first(F.lit("list")).alias("name"))
    return _landed(spark, raw, "Watchlist").select("watchlist_id", F.size("tickers").cast("long").alias("n"), F.array_join(F.array_sort("tickers"), ",").alias("tickers"))


@query("records_locates", "SELECT o_orderkey::VARCHAR AS locate_id, (o_orderkey % 500)::BIGINT AS requested_qty, CASE WHEN o_orderkey % 3 = 0 THEN 'not_reported' END AS why FROM orders WHERE o_orderkey < 2000")
def records_locates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").filter("o_orderkey < 2000")
    raw = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("ABC").alias("symbol"), F.lit("located").alias("status"), (F.col("o_orderkey") % 500).alias("requested_qty"), F.when(F.col("o_orderkey") % 3 > 0, F.lit("0.25")).alias("located_price"))
    return _landed(spark, raw, "Locate").select("locate_id", "requested_qty", F.try_element_at("absent", F.lit("located_price")).alias("why"))


@query("records_filing_hits", "SELECT o_orderkey::VARCHAR AS accession_number, o_orderdate::DATE AS filing_date FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (3, 4, 5) AND o_orderdate >= TIMESTAMP '1996-01-01' ORDER BY o_orderdate::DATE DESC, o_orderkey::VARCHAR LIMIT 10 OFFSET 5")
def records_filing_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    raw = o.select(F.col("o_orderkey").cast("string").alias("accession_number"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.col("o_orderstatus").alias("form"), F.to_date("o_orderdate").alias("filing_date"))
    return rec.filing_hits(_landed(spark, raw, "FilingHit"), ["F", "P"], ["3", "4", "5"], "1996-01-01", limit=10, offset=5).select("accession_number", "filing_date")


# --- Feeds ---------------------------------------------------------------------------------------


def _feeds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Nations as an RSS feed and suppliers' nations as an Atom feed: some items are in both."""
    from vantidal.sources.landed import atom, feed

    root = f"{shared_dir(spark)}/feeds-{uuid.uuid4().hex}"
    delete_on_exit(spark, root)
    n = load(spark, sf_dir, "nation")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey"))
    item = F.concat(F.lit("<item><title>"), "n_name", F.lit("</title><link>http://x/"), "n_nationkey", F.lit("</link><pubDate>"), F.date_format(day, "EEE, d MMM yyyy"), F.lit(" 00:00:00 +0000</pubDate><guid>g"), "n_nationkey", F.lit("</guid></item>"))
    entry = F.concat(
        F.lit('<entry><title>again '), "n_name", F.lit('</title><link rel="self" href="http://self"/><link href="http://x/'), "n_nationkey", F.lit('"/><updated>'), F.date_format(day, "yyyy-MM-dd'T'00:00:00'Z'"),
        F.lit("</updated><id>"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("g")).otherwise(F.lit("a")), "n_nationkey", F.lit("</id></entry>"),
    )
    for name, rows, tag in (("rss", n.filter("n_nationkey < 15").select(item.alias("value")), "rss"), ("atom", n.filter("n_nationkey >= 10").select(entry.alias("value")), "feed")):
        whole = rows.coalesce(1).groupBy().agg(F.concat(F.lit(f"<{tag}>"), F.array_join(F.collect_list("value"), ""), F.lit(f"</{tag}>")).alias("value"))
        whole.write.text(f"{root}/{name}")
    return [feed(spark, f"{root}/rss"), atom(spark, f"{root}/atom")]


@query("feed_rss", "SELECT n_name AS title, 'http://x/' || n_nationkey AS link, (DATE '2024-01-01' + n_nationkey)::TIMESTAMP AS published, 'g' || n_nationkey AS guid FROM nation WHERE n_nationkey < 15")
def feed_rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feeds(spark, sf_dir)[0]


@query("feed_atom", "SELECT 'again ' || n_name AS title, 'http://x/' || n_nationkey AS link, (DATE '2024-01-01' + n_nationkey)::TIMESTAMP AS published, CASE WHEN n_nationkey % 2 = 0 THEN 'g' ELSE 'a' END || n_nationkey AS guid FROM nation WHERE n_nationkey >= 10")
def feed_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feeds(spark, sf_dir)[1]


@query(
    "news_official",
    """SELECT CASE WHEN n_nationkey < 15 THEN n_name ELSE 'again ' || n_name END AS title, CASE WHEN n_nationkey < 15 OR n_nationkey % 2 = 0 THEN 'g' ELSE 'a' END || n_nationkey AS guid
FROM nation WHERE n_nationkey BETWEEN 5 AND 20 AND lower(n_name) LIKE '%a%'""",
)
def news_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two feeds, each once, by guid and by link, within a window and with a word."""
    from vantidal.sources.landed import news_of_feeds

    rss, atom_ = _feeds(spark, sf_dir)
    out = news_of_feeds([rss, atom_], None, "2024-01-06", "2024-01-21")
    plain = F.regexp_replace(F.lower("title"), "^again ", "")
    return out.filter(plain.contains("a")).select("title", "guid")


# --- Further aggregates --------------------------------------------------------------------------


@query("agg_entropy", "SELECT user_id, round(entropy(event_type), 8) AS entropy FROM events GROUP BY user_id")
def agg_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantidal.operators.relational import entropy

    return entropy(load(spark, sf_dir, "events"), ["user_id"], "event_type").withColumn("entropy", F.round("entropy", 8))


@query("agg_histogram", "SELECT n_regionkey, k AS name_length, n FROM (SELECT n_regionkey, unnest(map_entries(histogram(length(n_name)))) AS e FROM nation GROUP BY n_regionkey), LATERAL (SELECT e.key::BIGINT AS k, e.value::BIGINT AS n)")
def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantidal.operators.relational import value_counts

    n = load(spark, sf_dir, "nation").select("n_regionkey", F.length("n_name").cast("long").alias("name_length"))
    return value_counts(n, ["n_regionkey"], "name_length")


@query(
    "agg_more",
    """SELECT event_type, bit_and(event_id) AS a, bit_or(event_id) AS b, arg_min(event_id, (value, event_id)) AS c, max(ts) AS d, round(regr_r2(value, user_id), 8) AS e, regr_count(value, user_id)::BIGINT AS f, round(regr_avgx(value, user_id), 6) AS g,
  round(var_pop(value), 4) AS h, round(product(1 + value / 1e6), 8) AS i, count_if(value > 50)::BIGINT AS j, round(kurtosis(value), 4) AS k FROM (SELECT * FROM events WHERE event_id % 3 = 0) GROUP BY event_type""",
)
def agg_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v, u = load(spark, sf_dir, "events").filter("event_id % 3 = 0"), F.col("value"), F.col("user_id")
    n = F.count("value")
    k = ((n + 1) * F.kurtosis("value") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return e.groupBy("event_type").agg(
        F.bit_and("event_id").alias("a"), F.bit_or("event_id").alias("b"), F.min_by("event_id", F.struct("value", "event_id")).alias("c"), F.max("ts").alias("d"), F.round(F.regr_r2(v, u.cast("double")), 8).alias("e"), F.regr_count(v, u).alias("f"),
        F.round(F.regr_avgx(v, u.cast("double")), 6).alias("g"), F.round(F.var_pop("value"), 4).alias("h"), F.round(F.exp(F.sum(F.log1p(v / 1e6))), 8).alias("i"), F.count_if(v > 50).alias("j"), F.round(k, 4).alias("k"),
    )


@query("agg_approximate", "SELECT event_type, true AS distinct_near, true AS quantile_near FROM events GROUP BY event_type")
def agg_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate aggregates are near the exact ones: distinct users within a tenth, the median within two percent of ranks."""
    e = load(spark, sf_dir, "events")
    out = e.groupBy("event_type").agg(
        F.approx_count_distinct("user_id").alias("a"), F.countDistinct("user_id").alias("b"), F.percentile_approx("value", 0.5, 1000).alias("m"), F.percentile("value", F.array(F.lit(0.48), F.lit(0.52))).alias("r")
    )
    return out.select("event_type", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("distinct_near"), F.col("m").between(F.col("r")[0], F.col("r")[1]).alias("quantile_near"))
