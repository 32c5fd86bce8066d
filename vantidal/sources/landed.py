"""Sources from landed files: vendor JSON with grouped records, wide CSV curves, fixed-width indexes, XML feeds.

All are Spark readers with explicit schemas: files are split among tasks, columns that aren't asked for
aren't parsed, malformed records are counted and left out instead of failing the read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantidal.errors import Refusal
from vantidal.schema.models import MODELS, Model, conform
from vantidal.sources.parsing import instant, option_symbol

#: The short names of vendor records.
BAR = "t string, o double, h double, l double, c double, v double, n bigint, vw double"
QUOTE = "t string, bp double, bs double, bx string, ap double, `as` double, ax string, c array<string>, z string"
TRADE = "t string, p double, s double, x string, i string, c array<string>, z string, tks string"


@dataclass
class Read:
    """Rows, and the records that couldn't be read."""

    rows: DataFrame
    skipped: DataFrame

    def skipped_count(self) -> int:
        return self.skipped.count()


def grouped_json(spark: SparkSession, path: str, key: str, record: str) -> Read:
    """`{key: {SYMBOL: [records]}, next_page_token}` as rows (symbol, record), one file a page."""
    schema = f"`{key}` map<string,array<struct<{_colons(record)}>>>, next_page_token string, _corrupt string"
    pages = spark.read.text(path, wholetext=True)  # a page is small: the vendor caps its rows
    raw = pages.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("p")).select("p.*")
    good, bad = raw.filter("_corrupt IS NULL"), raw.filter("_corrupt IS NOT NULL").select("_corrupt")
    rows = good.select(F.explode(F.map_entries(key)).alias("e")).select(F.col("e.key").alias("symbol"), F.explode("e.value").alias("r"))
    return Read(rows.filter("r IS NOT NULL"), bad)


def _colons(record: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (f.strip().split(" ", 1) for f in record.split(", ")))


def bars(spark: SparkSession, path: str, timeframe: str, asset_class: str = "us_equity", currency: str = "USD") -> Read:
    """Bars of landed pages in the Bar model; a bar without time or prices is skipped."""
    got = grouped_json(spark, path, "bars", BAR)
    ok = F.col("t").isNotNull() & F.col("r.o").isNotNull() & F.col("r.h").isNotNull() & F.col("r.l").isNotNull() & F.col("r.c").isNotNull()
    timed = got.rows.withColumn("t", instant(F.col("r.t")))
    rows = timed.filter(ok).select(
        F.col("symbol").alias("ticker"), F.lit(asset_class).alias("asset_class"), F.lit(timeframe).alias("timeframe"), "t",
        F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"), F.col("r.c").alias("close"),
        F.coalesce("r.v", F.lit(0.0)).alias("volume"), F.col("r.n").alias("trade_count"), F.col("r.vw").alias("vwap"), F.lit(currency).alias("currency"),
    )
    bad = got.skipped.union(timed.filter(~F.coalesce(ok, F.lit(False))).select(F.to_json("r")))
    return Read(conform(rows, MODELS["Bar"]), bad)


def quotes(spark: SparkSession, path: str, asset_class: str = "us_equity", currency: str = "USD") -> Read:
    """Quotes in the Quote model; a price of 0 means that the side is missing."""
    got = grouped_json(spark, path, "quotes", QUOTE)
    timed = got.rows.withColumn("t", instant(F.col("r.t")))
    side = lambda price, value: F.when(F.col(price) > 0, F.col(value))
    rows = timed.filter("t IS NOT NULL").select(
        F.col("symbol").alias("ticker"), F.lit(asset_class).alias("asset_class"), "t",
        side("r.bp", "r.bp").alias("bid_price"), side("r.bp", "r.bs").alias("bid_size"), side("r.bp", "r.bx").alias("bid_exchange"),
        side("r.ap", "r.ap").alias("ask_price"), side("r.ap", "r.as").alias("ask_size"), side("r.ap", "r.ax").alias("ask_exchange"),
        F.col("r.c").alias("conditions"), F.col("r.z").alias("tape"), F.lit(currency).alias("currency"),
    )
    return Read(conform(rows, MODELS["Quote"], {"bid_price": "not_available", "ask_price": "not_available"}), got.skipped.union(timed.filter("t IS NULL").select(F.to_json("r"))))


def trades(spark: SparkSession, path: str, asset_class: str = "us_equity", currency: str = "USD") -> Read:
    got = grouped_json(spark, path, "trades", TRADE)
    timed = got.rows.withColumn("t", instant(F.col("r.t")))
    ok = F.col("t").isNotNull() & (F.col("r.p") > 0)
    rows = timed.filter(ok).select(
        F.col("symbol").alias("ticker"), F.lit(asset_class).alias("asset_class"), "t", F.col("r.p").alias("price"), F.coalesce("r.s", F.lit(0.0)).alias("size"),
        F.col("r.x").alias("exchange"), F.col("r.i").alias("trade_id"), F.col("r.c").alias("conditions"), F.col("r.z").alias("tape"),
        F.when(F.col("r.tks") == "B", "buy").when(F.col("r.tks") == "S", "sell").alias("taker_side"), F.lit(currency).alias("currency"),
    )
    return Read(conform(rows, MODELS["Trade"]), got.skipped.union(timed.filter(~F.coalesce(ok, F.lit(False))).select(F.to_json("r"))))


def portfolio_history(spark: SparkSession, path: str, environment: str, timeframe: str) -> DataFrame:
    """Parallel arrays of one account as rows; null entries stay null with a reason."""
    schema = "timestamp array<bigint>, equity array<string>, profit_loss array<string>, profit_loss_pct array<double>, base_value string"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select(F.explode(F.arrays_zip("timestamp", "equity", "profit_loss", "profit_loss_pct")).alias("p"), "base_value").select(
        F.lit(environment).alias("environment"), F.lit(timeframe).alias("timeframe"), F.timestamp_seconds("p.timestamp").alias("t"),
        F.col("p.equity").alias("equity"), F.col("p.profit_loss").alias("profit_loss"), F.col("p.profit_loss_pct").alias("profit_loss_pct"), "base_value",
    )
    return conform(rows.filter("t IS NOT NULL"), MODELS["PortfolioPoint"])


def option_chain(spark: SparkSession, path: str) -> DataFrame:
    """A chain's snapshots as rows: the symbol's parts, latest trade and quote, greeks, implied volatility."""
    schema = (
        "snapshots map<string,struct<latestTrade:struct<t:string,p:double,s:double>,latestQuote:struct<t:string,bp:double,ap:double>,"
        "greeks:struct<delta:double,gamma:double,theta:double,vega:double,rho:double>,impliedVolatility:double>>, next_page_token string"
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select(F.explode(F.map_entries("snapshots")).alias("e")).select(F.col("e.key").alias("occ_symbol"), option_symbol(F.col("e.key")).alias("o"), F.col("e.value").alias("v"))
    return rows.select(
        "occ_symbol", F.col("o.root").alias("root"), F.col("o.expiration").alias("expiration_date"), F.col("o.kind").alias("option_type"), F.col("o.strike").alias("strike"),
        instant(F.col("v.latestTrade.t")).alias("last_t"), F.col("v.latestTrade.p").alias("last_price"), F.col("v.latestQuote.bp").alias("bid_price"),
        F.col("v.latestQuote.ap").alias("ask_price"), F.col("v.greeks.delta").alias("delta"), F.col("v.greeks.gamma").alias("gamma"),
        F.col("v.greeks.theta").alias("theta"), F.col("v.greeks.vega").alias("vega"), F.col("v.greeks.rho").alias("rho"), F.col("v.impliedVolatility").alias("implied_volatility"),
    )


def curve_csv(spark: SparkSession, path: str, date_format: str = "MM/dd/yyyy", day: str = "Date") -> DataFrame:
    """A wide curve (a day, then a column a tenor, percent) as rows (day, tenor, months, rate); blanks are left out."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    tenors = [c for c in raw.columns if c != day]
    long = raw.unpivot([day], tenors, "tenor", "rate")
    n = F.regexp_extract("tenor", r"^([\d.]+)", 1).try_cast("double")
    months = F.when(F.lower("tenor").contains("yr"), n * 12).otherwise(n)
    return long.select(
        F.to_date(day, date_format).alias("day"), "tenor", months.alias("months"), (F.col("rate").try_cast("double") / 100).alias("rate")
    ).filter("rate IS NOT NULL")


def fixed_width(spark: SparkSession, path: str, columns: list[tuple[str, int, int]], skip: str = r"^(-+|\s*)$") -> DataFrame:
    """Lines cut at fixed places: (name, first, length) from 1. Rulers and blank lines are left out."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(skip))
    return lines.select(*(F.trim(F.substring("value", at, n)).alias(c) for c, at, n in columns))


def filing_index(spark: SparkSession, path: str, columns: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """A daily filing index: form, company, cik, day, file; header lines have no number in the cik's place."""
    places = columns or [("form", 1, 12), ("company", 13, 62), ("cik", 75, 12), ("day", 87, 12), ("file", 99, 200)]
    rows = fixed_width(spark, path, places).filter(F.col("cik").rlike(r"^\d+$"))
    return rows.withColumn("day", F.try_to_timestamp(F.regexp_replace("day", "-", ""), F.lit("yyyyMMdd")).cast("date"))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS feeds as rows (title, link, published, guid). Files with a DOCTYPE or ENTITY are refused whole."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    bad = whole.filter(F.upper("value").rlike(r"<!\s*(DOCTYPE|ENTITY)"))
    if not bad.isEmpty():
        raise Refusal("invalid_arguments", "A feed declares a document type or entities.")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "link", "pubDate", "guid")])
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    published = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return items.select("title", "link", published.alias("published"), "guid")


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds in the columns of `feed`; the link that isn't the entry's own document is left out."""
    whole = spark.read.text(path, wholetext=True)
    if not whole.filter(F.upper("value").rlike(r"<!\s*(DOCTYPE|ENTITY)")).isEmpty():
        raise Refusal("invalid_arguments", "A feed declares a document type or entities.")
    link = T.ArrayType(T.StructType([T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType())]))
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("link", link), *(T.StructField(c, T.StringType()) for c in ("published", "updated", "id"))])
    entries = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return entries.select("title", F.get(own, F.lit(0))["_href"].alias("link"), instant(F.coalesce("published", "updated")).alias("published"), F.col("id").alias("guid"))


def news_of_feeds(feeds: list[DataFrame], query: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Items of several feeds: of those that share a guid or a link the first feed's stays; words are looked for in the title,
    whatever the case; newest first."""
    rows = None
    for i, f in enumerate(feeds):
        one = f.withColumn("rank", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    for key in ("guid", "link"):
        known = rows.filter(F.col(key).isNotNull())
        order = F.struct("rank", F.coalesce("guid", F.lit("")), F.coalesce("link", F.lit("")))
        rest = [c for c in rows.columns if c != key]
        first = known.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(key, "__row.*").select(*rows.columns)
        rows = first.unionByName(rows.filter(F.col(key).isNull()))
    for word in (query or "").lower().split():
        rows = rows.filter(F.lower("title").contains(word))
    if start:
        rows = rows.filter(F.col("published") >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.filter(F.col("published") <= F.lit(end).cast("timestamp"))
    return rows.drop("rank").orderBy(F.col("published").desc_nulls_last(), "guid")


def to_model(df: DataFrame, model: Model) -> DataFrame:
    return conform(df, model)
