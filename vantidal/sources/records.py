"""Records of brokers, exchanges and registries: landed JSON in the columns of a model, and what each request does with them.

Everything is read as text and cast by the model, so decimals stay exact. A record without its key columns is skipped and
counted; fields that a shape doesn't name aren't parsed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantidal.errors import Refusal
from vantidal.schema.models import Model, conform, model
from vantidal.sources.landed import Read
from vantidal.sources.parsing import fraction, instant, option_symbol


@dataclass(frozen=True)
class Shape:
    """A model, the records' names where they differ, the columns that a record must have, and percentages."""

    model: Model
    names: dict[str, str] = field(default_factory=dict)
    need: tuple[str, ...] = ()
    percents: tuple[str, ...] = ()
    no_zero: tuple[str, ...] = ()  #: prices of 0 mean that there is none


def shape(name: str, fields: str, names: str = "", need: str = "", percents: str = "", no_zero: str = "", **roles) -> Shape:
    return Shape(model(name, fields, **roles), dict(n.split("=") for n in names.split()), tuple(need.split()), tuple(percents.split()), tuple(no_zero.split()))


#: The names of the records' fields.
SHAPES = {s.model.name: s for s in (
    shape("Asset", "ticker:str asset_class:str name:str? exchange:str? status:str tradable:bool marginable:bool? shortable:bool? fractionable:bool? min_order_size:decimal? attributes:strs?",
          "ticker=symbol asset_class=class", "ticker status", group="ticker"),
    shape("OptionContract", "occ_symbol:str underlying:str root_symbol:str status:str expiration_date:date strike:float option_type:str style:str? open_interest:int? close_price:float?",
          "occ_symbol=symbol underlying=underlying_symbol strike=strike_price option_type=type", "occ_symbol expiration_date strike", group="occ_symbol"),
    shape("Announcement", "announcement_id:str ca_type:str initiating_ticker:str? target_ticker:str? cusip:str? declaration_date:date? ex_date:date? record_date:date? payable_date:date? cash:decimal?",
          "announcement_id=id initiating_ticker=initiating_symbol target_ticker=target_symbol cusip=initiating_original_cusip", "announcement_id ca_type"),
    shape("NewsItem", "news_id:str headline:str summary:str? content:str? author:str? url:str? tickers:strs? created_at:time updated_at:time?", "news_id=id tickers=symbols", "news_id headline created_at", time="created_at"),
    shape("Position", "ticker:str asset_class:str side:str qty:decimal avg_entry_price:decimal market_value:decimal? unrealized_pl:decimal? unrealized_plpc:float?", "ticker=symbol", "ticker qty", group="ticker"),
    shape("Order", "order_id:str ticker:str? side:str? order_type:str? status:str qty:decimal? filled_qty:decimal? limit_price:decimal? created_at:time parent_id:str?", "order_id=id ticker=symbol order_type=type", "order_id status created_at",
          time="created_at", group="ticker"),
    shape("Activity", "activity_id:str activity_type:str category:str t:time ticker:str? side:str? qty:decimal? price:decimal? net_amount:decimal?", "activity_id=id ticker=symbol", "activity_id activity_type", time="t", group="ticker"),
    shape("Account", "account_id:str account_number_masked:str? status:str currency:str cash:decimal equity:decimal buying_power:decimal", "account_id=id", "account_id"),
    shape("Watchlist", "watchlist_id:str name:str created_at:time? tickers:strs?", "watchlist_id=id", "watchlist_id"),
    shape("Locate", "locate_id:str ticker:str status:str requested_qty:int located_qty:int? located_price:decimal? total_fee:decimal? created_at:time?", "locate_id=id ticker=symbol", "locate_id"),
    shape("BondQuote", "isin:str t:time bid_price:float? ask_price:float? bid_size:float? ask_size:float? bid_ytm:float? ask_ytm:float?", "bid_price=bp ask_price=ap bid_size=bs ask_size=as bid_ytm=bytm ask_ytm=aytm", "isin t", "bid_ytm ask_ytm",
          "bid_price ask_price", time="t", group="isin"),
    shape("FilingHit", "accession_number:str cik:str entity_name:str? form:str filing_date:date document:str?", "", "accession_number form filing_date", time="filing_date", group="cik"),
)}


def read_records(spark: SparkSession, path: str, name: str, root: str | None = None, lines: bool = False) -> Read:
    """Landed records of a shape: a JSON array, an object that holds the array under `root`, or a record a line."""
    s = SHAPES[name]
    kinds = {f.name: f.dataType for f in s.model.schema if f.name != "absent"}
    record = T.StructType([T.StructField(s.names.get(c, c), k if isinstance(k, T.ArrayType) else T.StringType()) for c, k in kinds.items()])
    schema = T.StructType([T.StructField(root, T.ArrayType(record))]) if root else record
    raw = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    if root:
        raw = raw.select(F.explode(root).alias("r")).select("r.*")
    return in_shape(raw, name)


def in_shape(raw: DataFrame, name: str) -> Read:
    """Text columns under the records' names as rows of the shape's model."""
    s = SHAPES[name]
    kinds = {f.name: f.dataType for f in s.model.schema if f.name != "absent"}
    ok, cols = F.lit(True), []
    for c, kind in kinds.items():
        source = s.names.get(c, c)
        x = F.col(f"`{source}`") if source in raw.columns else F.lit(None).cast("string")
        if isinstance(kind, T.TimestampType):
            x = instant(x) if dict(raw.dtypes).get(source) == "string" else x
        elif not isinstance(kind, (T.StringType, T.ArrayType, T.DecimalType)):
            x = x.try_cast(kind)
        if c in s.percents:
            x = fraction(x)
        if c in s.no_zero:
            x = F.when(x != 0, x)
        cols.append(x.alias(c))
        if c in s.need:
            ok &= x.isNotNull()
    kept = raw.select(*cols, ok.alias("__ok"), F.to_json(F.struct(*raw.columns)).alias("__raw"))
    return Read(conform(kept.filter("__ok").drop("__ok", "__raw"), s.model), kept.filter("NOT __ok").select(F.col("__raw").alias("_corrupt")))


def one(df: DataFrame, column: str, value: str) -> DataFrame:
    """A single record by its id or symbol; an unknown one is refused."""
    out = df.filter(F.col(column) == value).limit(1)
    if out.isEmpty():
        raise Refusal("not_found", f"There is no {column} {value}.")
    return out


def _any(column: str, values: list[str] | None) -> Column:
    return F.col(column).isin(list(values)) if values else F.lit(True)


def assets(df: DataFrame, status: str | None = None, asset_class: str | None = None, exchange: str | None = None, attributes: list[str] | None = None) -> DataFrame:
    """The asset master by class, status, exchange and attributes (any of them)."""
    out = df.filter(_any("status", [status] if status else None) & _any("asset_class", [asset_class] if asset_class else None) & _any("exchange", [exchange] if exchange else None))
    return out.filter(F.arrays_overlap("attributes", F.array(*(F.lit(a) for a in attributes)))) if attributes else out


def contracts(
    df: DataFrame, today: str, status: str | None = None, underlyings: list[str] | None = None, option_type: str | None = None, style: str | None = None, root: str | None = None,
    strikes: tuple[float | None, float | None] = (None, None), expirations: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """Option contracts. Active ones without bounds of their expiration begin with those that expire today or later."""
    first, last = expirations
    if first is None and last is None and status != "inactive":
        first = today
    out = df.filter(_any("status", [status] if status else None) & _any("underlying", underlyings) & _any("option_type", [option_type] if option_type else None) & _any("style", [style] if style else None) & _any("root_symbol", [root] if root else None))
    for c, low, high in (("strike", *strikes), ("expiration_date", first, last)):
        out = out.filter(F.col(c) >= F.lit(low)) if low is not None else out
        out = out.filter(F.col(c) <= F.lit(high)) if high is not None else out
    return out


def corporate_actions(kinds: dict[str, DataFrame], columns: dict[str, str]) -> DataFrame:
    """Actions of many shapes as one table: the columns that a kind lacks are null, not applicable."""
    out = None
    for kind, df in sorted(kinds.items()):
        lacking = [c for c in columns if c not in df.columns]
        codes = F.map_from_arrays(F.array(*(F.lit(c) for c in lacking)), F.array(*(F.lit("not_applicable") for _ in lacking))) if lacking else F.create_map().cast("map<string,string>")
        missing = [c for c in columns if c in df.columns]
        said = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.when(F.col(c).isNull(), F.lit("not_reported")).alias("value")) for c in missing)), lambda e: e["value"].isNotNull()))
        one_ = df.select(F.lit(kind).alias("action_type"), *((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in columns.items()), F.map_concat(codes, said).alias("absent"))
        out = one_ if out is None else out.unionByName(one_)
    if out is None:
        raise Refusal("invalid_arguments", "There are no corporate actions.")
    return out


def announcements(df: DataFrame, kinds: list[str], since: str, until: str, ticker: str | None = None, cusip: str | None = None, date_type: str = "ex_date") -> DataFrame:
    """Announcements of some kinds whose date of one type lies in a window of 90 days at most."""
    if date_type not in ("declaration_date", "ex_date", "record_date", "payable_date"):
        raise Refusal("invalid_arguments", f"'{date_type}' is no date of an announcement.")
    return df.filter(_any("ca_type", kinds) & F.col(date_type).between(F.lit(since).cast("date"), F.lit(until).cast("date")) & (
        (F.col("initiating_ticker") == ticker) | (F.col("target_ticker") == ticker) if ticker else F.lit(True)) & (F.col("cusip") == cusip if cusip else F.lit(True)))


#: Entities that headlines hold.
ENTITIES = {"&#39;": "'", "&apos;": "'", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def unescaped(text: Column) -> Column:
    for k, v in ENTITIES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def news_search(df: DataFrame, tickers: list[str] | None = None, query: str | None = None, start: str | None = None, end: str | None = None, exclude_contentless: bool = False, sort: str = "desc") -> DataFrame:
    """Articles by tickers (any) and by words: all of them, as whole words in any case, in headline or summary. A ticker with
    a share class isn't matched by its root. Newest first, or oldest."""
    import re

    out = df.filter(F.arrays_overlap("tickers", F.array(*(F.lit(t) for t in tickers)))) if tickers else df
    text = unescaped(F.concat_ws("\n", "headline", "summary"))
    for word in (query or "").split():
        out = out.filter(text.rlike(rf"(?iu)(?<!\w){re.escape(word)}(?!\w)"))
    if start:
        out = out.filter(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.filter(F.col("created_at") <= F.lit(end).cast("timestamp"))
    if exclude_contentless:
        out = out.filter(F.length(F.trim(F.coalesce("content", F.lit("")))) > 0)
    at = F.col("created_at")
    return out.orderBy(at.asc() if sort == "asc" else at.desc(), "news_id")


def orders(
    df: DataFrame, status: str = "open", tickers: list[str] | None = None, side: str | None = None, after: str | None = None, until: str | None = None, direction: str = "desc"
) -> DataFrame:
    """Orders by status (open, closed, all), tickers and side, within bounds that don't belong to the window."""
    closed = F.col("status").isin("filled", "canceled", "expired", "rejected", "replaced", "done_for_day")
    if status not in ("open", "closed", "all"):
        raise Refusal("invalid_arguments", "The status is open, closed or all.")
    out = df.filter({"open": ~closed, "closed": closed, "all": F.lit(True)}[status] & _any("ticker", tickers) & _any("side", [side] if side else None))
    if after:
        out = out.filter(F.col("created_at") > F.lit(after).cast("timestamp"))
    if until:
        out = out.filter(F.col("created_at") < F.lit(until).cast("timestamp"))
    at = F.col("created_at")
    return out.orderBy(at.asc() if direction == "asc" else at.desc(), "order_id")


def page_after(df: DataFrame, order: str, last: str | None, size: int, key: str) -> DataFrame:
    """A page in an order of time, from the key of the page before on: rows of the same time are told apart by key."""
    if last is not None:
        at = df.filter(F.col(key) == last).select(F.col(order).alias("__at")).limit(1)
        df = df.join(F.broadcast(at), (F.col(order) < F.col("__at")) | ((F.col(order) == F.col("__at")) & (F.col(key) > F.lit(last)))).drop("__at")  # one row
    return df.orderBy(F.col(order).desc(), key).limit(size)


def activities(fills: DataFrame, others: DataFrame) -> DataFrame:
    """Fills and other activities as one table: trades have an instant, others a day, placed at its midnight (UTC)."""
    trade = fills.select(
        F.col("id").alias("activity_id"), F.lit("FILL").alias("activity_type"), F.lit("trade").alias("category"), F.col("transaction_time").alias("t"), F.col("symbol").alias("ticker"), "side",
        F.col("qty").cast("decimal(38,12)").alias("qty"), F.col("price").cast("decimal(38,12)").alias("price"), F.lit(None).cast("decimal(38,12)").alias("net_amount"),
    )
    rest = others.select(
        F.col("id").alias("activity_id"), "activity_type", F.lit("non_trade").alias("category"), F.col("date").cast("date").cast("timestamp").alias("t"), F.col("symbol").alias("ticker"), F.lit(None).cast("string").alias("side"),
        F.lit(None).cast("decimal(38,12)").alias("qty"), F.lit(None).cast("decimal(38,12)").alias("price"), F.col("net_amount").cast("decimal(38,12)").alias("net_amount"),
    )
    return trade.unionByName(rest)


def masked(number: Column) -> Column:
    """An account number with all but its last four signs hidden."""
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(number) - 4, F.lit(0))), F.substring(number, -4, 4))


def option_rows(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Bars, quotes and trades of options with what their symbol says: underlying, expiration, type and strike. Rows whose
    symbol isn't one are left out."""
    o = option_symbol(F.col(symbol))
    out = df.withColumn("__o", o).filter("__o IS NOT NULL")
    return out.select(
        F.regexp_replace(F.upper(symbol), r"\s", "").alias("occ_symbol"), F.col("__o.root").alias("underlying"), F.col("__o.expiration").alias("expiration_date"), F.col("__o.kind").alias("option_type"),
        F.col("__o.strike").alias("strike"), *(c for c in df.columns if c != symbol),
    )


def filing_hits(df: DataFrame, forms: list[str] | None = None, ciks: list[str] | None = None, start: str | None = None, end: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Search hits by form, company and filing date, newest first, a page at an offset."""
    if not 1 <= limit <= 100 or offset < 0:
        raise Refusal("invalid_arguments", "A page has 1 to 100 hits.")
    out = df.filter(_any("form", forms) & _any("cik", [c.zfill(10) for c in ciks] if ciks else None))
    if start:
        out = out.filter(F.col("filing_date") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("filing_date") <= F.lit(end).cast("date"))
    return out.orderBy(F.col("filing_date").desc(), "accession_number").offset(offset).limit(limit)
