"""Market tables: order books, snapshots, rankings, sessions, code lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantidal.errors import Refusal
from vantidal.functions.timeframes import BAR_ZONE
from vantidal.operators.relational import absent_map, latest_row


def order_book(books: DataFrame, depth: int = 20) -> DataFrame:
    """(ticker, t, bids, asks) with arrays of (p, s) as levels: bids from the highest, asks from the lowest price.

    Levels of size 0 are gone. Levels count from 0.
    """
    def keyed(sign: int):
        return lambda x: F.struct((x["p"] * sign).alias("k"), x["p"].alias("p"), x["s"].alias("s"))

    out = None
    for side, column, sign in (("bid", "bids", -1), ("ask", "asks", 1)):
        there = F.filter(column, lambda x: x["s"] > 0)
        levels = F.slice(F.array_sort(F.transform(there, keyed(sign))), 1, depth)
        one = books.select("ticker", "t", F.lit(side).alias("side"), F.posexplode(levels).alias("level", "x"))
        one = one.select("ticker", "t", "side", "level", F.col("x.p").alias("price"), F.col("x.s").alias("size"))
        out = one if out is None else out.union(one)
    return out


def latest(df: DataFrame, key: str = "ticker", time: str = "t", *tie: str) -> DataFrame:
    return latest_row(df, [key], time, *tie)


def change_columns(df: DataFrame, every_day: bool = False, irregular: tuple[str, ...] = ()) -> DataFrame:
    """change, change_pct and change_basis of snapshots (last_price, last_t, day_close, day_t, prev_close, conditions).

    The last trade counts if it belongs to the day's bar and is regular; else the day's close. Null without a base or
    a previous close; change_pct is null for a previous close of 0.
    """
    zone = "UTC" if every_day else BAR_ZONE
    same = F.to_date(F.from_utc_timestamp("last_t", zone)) == F.to_date(F.from_utc_timestamp("day_t", zone))
    odd = F.arrays_overlap(F.coalesce("conditions", F.array().cast("array<string>")), F.array(*(F.lit(c) for c in irregular)).cast("array<string>")) if irregular and "conditions" in df.columns else F.lit(False)
    trade = F.col("last_price").isNotNull() & (F.col("day_close").isNull() | (F.coalesce(same, F.lit(False)) & ~odd))
    basis = F.when(trade, F.lit("last_trade")).when(F.col("day_close").isNotNull(), F.lit("day_close"))
    base = F.when(basis == "last_trade", F.col("last_price")).when(basis == "day_close", F.col("day_close"))
    change = base - F.col("prev_close")
    return df.withColumns({
        "change": change, "change_pct": F.try_divide(change, F.nullif(F.col("prev_close"), F.lit(0.0))), "change_basis": F.when(change.isNotNull(), basis),
    })


def movers(df: DataFrame, top: int = 10, least_price: float | None = None, exclude: str | None = None, quote: str | None = None) -> DataFrame:
    """The top gainers and losers by change_pct, ranked from 1 in each direction.

    `exclude` is a pattern of tickers (warrants, rights, units); `quote` keeps pairs of one currency.
    """
    if not 1 <= top <= 100:
        raise Refusal("invalid_arguments", "top is between 1 and 100.")
    rows = df.filter(F.col("change_pct").isNotNull() & (F.col("change_pct") != 0))
    if least_price is not None:
        rows = rows.filter(F.col("price") >= least_price)
    if exclude:
        rows = rows.filter(~F.col("ticker").rlike(exclude))
    if quote:
        rows = rows.filter(F.col("ticker").endswith("/" + quote))
    out = None
    for name, keep, order in (("gainer", F.col("change_pct") > 0, F.col("change_pct").desc()), ("loser", F.col("change_pct") < 0, F.col("change_pct").asc())):
        one = rows.filter(keep).orderBy(order, "ticker").limit(top).withColumn("direction", F.lit(name))
        one = one.withColumn("rank", F.row_number().over(Window.orderBy(order, "ticker")))  # `top` rows
        out = one if out is None else out.unionByName(one)
    return out


def most_active(ranking: DataFrame, snapshots: DataFrame, by: str = "volume", top: int = 10, least_price: float | None = None) -> DataFrame:
    """The most active tickers by volume or trades, with their snapshots' price and change where there are any."""
    if by not in ("volume", "trade_count"):
        raise Refusal("invalid_arguments", "Rankings are by volume and trade_count.")
    if not 1 <= top <= 100:
        raise Refusal("invalid_arguments", "top is between 1 and 100.")
    info = snapshots.select("ticker", F.coalesce("last_price", "day_close").alias("price"), "change", "change_pct", "change_basis")
    rows = ranking.join(info, "ticker", "left")
    if least_price is not None:
        rows = rows.filter(F.col("price") >= least_price)
    out = rows.orderBy(F.col(by).desc_nulls_last(), "ticker").limit(top)
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc_nulls_last(), "ticker"))).withColumn("ranked_by", F.lit(by))
    return out.withColumn("absent", absent_map(["price", "change", "change_pct"], "not_found"))


def sessions(days: DataFrame, zone: str = BAR_ZONE) -> DataFrame:
    """Trading days (date, open, close, session_open, session_close as HH:MM in the zone) with instants."""
    at = lambda c: F.to_utc_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.regexp_replace(c, r"^(\d{2}):?(\d{2})$", "$1:$2")).try_cast("timestamp"), zone)
    return days.withColumns({c: at(c) for c in ("open", "close", "session_open", "session_close") if c in days.columns})


def clock(days: DataFrame, now: str) -> DataFrame:
    """One row: whether the market is open at an instant, its next opening and closing."""
    t = F.lit(now).cast("timestamp")
    return days.agg(
        F.coalesce(F.bool_or((F.col("open") <= t) & (t < F.col("close"))), F.lit(False)).alias("is_open"),
        F.min(F.when(F.col("open") > t, F.col("open"))).alias("next_open"), F.min(F.when(F.col("close") > t, F.col("close"))).alias("next_close"),
    ).select(t.alias("t"), "*")


def codes(df: DataFrame, column: str, code: str = "code", name: str = "name") -> DataFrame:
    """A map of codes to names as rows."""
    return df.select(F.explode(column).alias(code, name))


def with_open_interest(chain: DataFrame, contracts: DataFrame) -> DataFrame:
    """A chain with its contracts' open interest and why it is missing. The planner broadcasts the contracts if it can."""
    info = contracts.select("occ_symbol", "open_interest", "open_interest_date", F.lit(True).alias("__hit"))
    out = chain.join(info, "occ_symbol", "left")
    why = F.when(F.col("__hit").isNull(), "not_found").otherwise("not_reported")
    entries = F.array(*(F.struct(F.lit(c).alias("key"), F.when(F.col(c).isNull(), why).alias("value")) for c in ("open_interest", "open_interest_date")))
    return out.withColumn("absent", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))).drop("__hit")


def option_filters(
    chain: DataFrame, kind: str | None = None, strikes: tuple[float | None, float | None] = (None, None), expirations: tuple[str | None, str | None] = (None, None), root: str | None = None
) -> DataFrame:
    """Contracts of a kind, a range of strikes and expirations, and a root symbol."""
    keep: Column = F.lit(True)
    if kind:
        keep &= F.col("option_type") == kind
    if root:
        keep &= F.col("root") == root
    for c, (low, high) in (("strike", strikes), ("expiration_date", expirations)):
        if low is not None:
            keep &= F.col(c) >= F.lit(low)
        if high is not None:
            keep &= F.col(c) <= F.lit(high)
    return chain.filter(keep)
