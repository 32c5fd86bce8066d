"""Landed files, vendor text, paging, and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vantidal.errors import Refusal
from vantidal.sources import landed, parsing
from vantidal.sources.paged import Page, TokenBucket, fetch_keys, paginate
from vantidal.streaming.resample import resample_stream


def values(spark, text, f):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_vendor_text(spark):
    got = values(spark, ["2026-03-02T10:00:00.123456789Z", "2026-03-02T10:00:00+02:00", "2026-03-02T10:00:00", "x"], parsing.instant)
    assert [str(g) for g in got] == ["2026-03-02 10:00:00.123456", "2026-03-02 08:00:00", "None", "None"]
    assert values(spark, ["PT5M", "P1DT1S", "P1M", ""], parsing.duration_seconds) == [300.0, 86401.0, None, None]
    assert values(spark, ["brk-b", " aapl ", "BTC/USD", "not a ticker"], parsing.ticker) == ["BRK.B", "AAPL", "BTC/USD", None]
    got = values(spark, ["AAPL  260320C00150500", "SPY260320P00400000", "AAPL"], parsing.option_symbol)
    assert (got[0].root, str(got[0].expiration), got[0].kind, got[0].strike) == ("AAPL", "2026-03-20", "call", 150.5) and got[1].kind == "put" and got[2] is None
    assert values(spark, ["12.5", "NaN", None], lambda c: parsing.fraction(c)) == [0.125, None, None]
    zone = spark.createDataFrame([("2026-07-01", "09:30"), ("2026-01-05", "09:30")], "d string, h string").select(parsing.wall_clock(F.col("d"), F.col("h")).alias("t"))
    assert [str(r.t) for r in zone.collect()] == ["2026-07-01 13:30:00", "2026-01-05 14:30:00"]


def test_grouped_pages(spark, tmp_path):
    bar = {"t": "2026-03-02T10:00:00Z", "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.5, "v": 10, "n": 3, "vw": 1.2}
    (tmp_path / "1.json").write_text(json.dumps({"bars": {"A": [bar, bar | {"o": None}], "B": [bar | {"vw": None}]}, "next_page_token": "x"}))
    (tmp_path / "2.json").write_text("{broken")
    got = landed.bars(spark, str(tmp_path), "1min")
    rows = {r.ticker: r for r in got.rows.collect()}
    assert set(rows) == {"A", "B"} and rows["B"].absent == {"vwap": "not_reported"} and got.skipped_count() == 2
    quote = {"t": "2026-03-02T10:00:00.1Z", "bp": 0, "bs": 1, "bx": "V", "ap": 2.0, "as": 3, "ax": "Q", "c": ["R"], "z": "C"}
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.json").write_text(json.dumps({"quotes": {"A": [quote]}, "next_page_token": None}))
    row = landed.quotes(spark, str(tmp_path / "q")).rows.first()
    assert row.bid_price is None and row.bid_size is None and row.ask_price == 2.0 and row.absent["bid_price"] == "not_available"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.json").write_text(json.dumps({"trades": {"A": [{"t": "2026-03-02T10:00:00Z", "p": 1.0, "s": 2.0, "x": "V", "i": "7", "c": None, "z": "C", "tks": "B"}, {"t": "x", "p": 1.0}]}}))
    got = landed.trades(spark, str(tmp_path / "t"))
    assert got.rows.first().taker_side == "buy" and got.skipped_count() == 1


def test_portfolio_and_chain(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"timestamp": [1772445600, 1772532000], "equity": ["10.5", None], "profit_loss": ["1", "2"], "profit_loss_pct": [0.1, None], "base_value": "9"}))
    rows = sorted(landed.portfolio_history(spark, str(tmp_path / "p.json"), "paper", "1d").collect(), key=lambda r: r.t)
    assert str(rows[0].equity) == "10.500000000000" and rows[1].equity is None and "equity" in rows[1].absent
    snap = {"latestTrade": {"t": "2026-03-02T10:00:00Z", "p": 1.0, "s": 1}, "latestQuote": {"t": "2026-03-02T10:00:00Z", "bp": 0.9, "ap": 1.1}, "greeks": {"delta": 0.5}, "impliedVolatility": 0.2}
    (tmp_path / "c.json").write_text(json.dumps({"snapshots": {"AAPL260320C00150000": snap}}))
    row = landed.option_chain(spark, str(tmp_path / "c.json")).first()
    assert (row.root, row.option_type, row.strike, row.delta, row.gamma, row.implied_volatility) == ("AAPL", "call", 150.0, 0.5, None, 0.2)


def test_curve_index_and_feed(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Date,1 Mo,2 Yr,30 Yr\n03/02/2026,4.10,,4.50\n")
    assert sorted((r.tenor, r.months, r.rate) for r in landed.curve_csv(spark, str(tmp_path / "c.csv")).collect()) == [("1 Mo", 1.0, 0.040999999999999995), ("30 Yr", 360.0, 0.045)]
    line = "4".ljust(12) + "ACME CORP".ljust(62) + "1234".ljust(12) + "20260302".ljust(12) + "edgar/data/1/x.txt"
    (tmp_path / "d.idx").write_text("Form Type   Company Name\n" + "-" * 80 + "\n" + line + "\n\n")
    row = landed.filing_index(spark, str(tmp_path / "d.idx")).first()
    assert (row.form, row.company, row.cik, str(row.day), row.file) == ("4", "ACME CORP", "1234", "2026-03-02", "edgar/data/1/x.txt")
    item = "<rss><channel><item><title>Hi</title><link>http://x</link><pubDate>Mon, 02 Mar 2026 10:00:00 +0000</pubDate><guid>1</guid></item></channel></rss>"
    (tmp_path / "f.xml").write_text(item)
    row = landed.feed(spark, str(tmp_path / "f.xml")).first()
    assert (row.title, str(row.published)) == ("Hi", "2026-03-02 10:00:00")
    (tmp_path / "g.xml").write_text("<!DOCTYPE x>" + item)
    with pytest.raises(Refusal):
        landed.feed(spark, str(tmp_path / "g.xml"))


def test_paging_and_pace(spark):
    pages = {None: Page([1, 2], "a"), "a": Page([3], "b"), "b": Page([4, 5], None)}
    assert paginate(pages.get).rows == [1, 2, 3, 4, 5] and paginate(pages.get, most_rows=3).truncated and paginate(pages.get, most_pages=2).rows == [1, 2, 3]
    assert not paginate({None: Page([1], "a"), "a": Page([2], "a")}.get).truncated
    now = [0.0]
    bucket = TokenBucket(60, 2, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert [round(bucket.take(), 3) for _ in range(4)] == [0, 0, 1, 1]
    got = fetch_keys(spark, ["a", "b", "c"], lambda key, token: Page([{"k": key, "n": 1}], "x" if token is None else None), "k string, n long", per_minute=6e4, tasks=2)
    assert sorted(r.k for r in got.collect()) == ["a", "a", "b", "b", "c", "c"]


def test_stream_equals_batch(spark, sf, tmp_path):
    from vantidal import catalog
    from vantidal.session import load

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = resample_stream(stream.filter("value IS NOT NULL"), "1d", "ts", "event_type", "value", "event_id", "0 seconds")
    name = "resampled"
    q = out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.series, r.t): (r.open, r.high, r.low, r.close, r.n) for r in spark.table(name).collect()}
    want = {(r.series, r.t): (r.open, r.high, r.low, r.close, r.n) for r in catalog.daily_bars(spark, sf).collect()}
    assert got == want and load(spark, sf, "events").count()


def test_datasets(spark):
    from vantidal.sources import datasets as ds

    rows = [("A", "2026-01-31", "2026-02-03", "10", "Note"), ("A", "2026-01-31", "2026-02-20", "12", "note two"), ("A", "2026-02-28", "2026-03-03", "14", "x"), ("B", "2026-01-31", None, "9", None)]
    df = spark.createDataFrame(rows, "id string, day string, known string, pct string, title string")
    df = df.select("id", F.col("day").cast("date").alias("day"), F.col("known").cast("timestamp").alias("knowledge_time"), "pct", "title")
    spec = ds.Dataset(("id", "day"), "day", (("day", "desc"), ("id", "asc")), ("pct",), search=("title",))
    assert [(r.id, str(r.day), r.pct) for r in ds.read_dataset(df, spec).rows.collect()] == [("A", "2026-02-28", 0.14), ("A", "2026-01-31", 0.12), ("B", "2026-01-31", 0.09)]
    assert [r.pct for r in ds.read_dataset(df, spec, as_of="2026-02-10").rows.collect()] == [0.10]
    assert ds.read_dataset(df, spec, vintages="all", id="A", start="2026-01-01", end="2026-01-31").rows.count() == 2
    got = ds.read_dataset(df, spec, q="NOTE", most=0)
    assert got.rows.count() == 1 and got.truncated() and got.capped().count() == 0
    order = ds.Dataset(("id", "day"), ranks={"title": ("x", "note two")})
    assert [r.title for r in ds.read_dataset(df, order).rows.collect()] == ["x", "note two", None]
    filings = spark.createDataFrame([("q", 1, "a1", "", 5), ("q", 2, "a2", "RESTATEMENT", 6), ("q", 3, "a3", "New Holdings", 7), ("q", 1, "a0", "NEW HOLDINGS", 8), ("p", 1, "b1", None, 9)], "period string, filed int, acc string, kind string, v int")
    assert sorted(r.v for r in ds.standing_portfolio(filings, "period", "filed", "acc", "kind").collect()) == [6, 7, 9]
    assert sorted(r.acc for r in ds.limit_groups(filings, "acc", F.col("filed"), 2).collect()) == ["a2", "a3"]
    assert {r.acc for r in ds.newest_report(filings, ["period"], "filed", "acc").collect()} == {"a3", "b1"}
    sec = spark.createDataFrame([("Note", "2-Year", False, 2.5, None), ("Note", "2-Year", True, 2.5, 1.0), ("Bill", "42-Day", False, 2.5, 1.0), ("Bill", "4-Week", False, None, None), ("Note", "2-Year", False, None, None)], "k string, t string, i boolean, b double, y double")
    assert [r[0] for r in sec.select(ds.security_class(*(F.col(c) for c in "ktiby"))).collect()] == ["FRN", "TIPS", "CMB", "Bill", "Note"]
    assert ds.growth(filings.select("period", F.lit("2026-01-31").cast("date").alias("d"), "v").limit(1), ["period"], "d", "v").first().growth is None
    both = ds.merged_publications(filings.select("acc", "v").limit(2), filings.select("acc", F.lit(1).alias("w")), ["acc"])
    assert both.count() == 5 and both.filter("v IS NOT NULL AND w IS NOT NULL").count() == 2


def test_market_tables(spark):
    from vantidal.operators import market

    books = spark.createDataFrame([("X", 1, [(1.0, 2.0), (3.0, 1.0), (2.0, 0.0)], [(5.0, 1.0), (4.0, 2.0)])], "ticker string, t int, bids array<struct<p:double,s:double>>, asks array<struct<p:double,s:double>>")
    assert [(r.side, r.level, r.price) for r in market.order_book(books).collect()] == [("bid", 0, 3.0), ("bid", 1, 1.0), ("ask", 0, 4.0), ("ask", 1, 5.0)]
    snaps = spark.createDataFrame(
        [("A", 11.0, "2026-03-02 15:00:00", 10.5, "2026-03-02 05:00:00", 10.0), ("B", 9.0, "2026-02-27 15:00:00", 9.5, "2026-03-02 05:00:00", 10.0), ("C", 5.0, None, None, None, 0.0), ("D", None, None, None, None, 1.0)],
        "ticker string, last_price double, last_t string, day_close double, day_t string, prev_close double",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("last_t", "day_t")})
    out = market.change_columns(snaps)
    assert {r.ticker: (r.change, r.change_basis) for r in out.collect()} == {"A": (1.0, "last_trade"), "B": (-0.5, "day_close"), "C": (5.0, "last_trade"), "D": (None, None)}
    moved = market.movers(out.withColumn("price", F.col("last_price")), 5)
    assert sorted((r.direction, r.rank, r.ticker) for r in moved.collect()) == [("gainer", 1, "A"), ("loser", 1, "B")]
    ranking = spark.createDataFrame([("A", 10.0, 5), ("Z", 20.0, 1)], "ticker string, volume double, trade_count long")
    assert [(r.ticker, r.rank, r.absent.get("price")) for r in sorted(market.most_active(ranking, out).collect(), key=lambda r: r.rank)] == [("Z", 1, "not_found"), ("A", 2, None)]
    days = market.sessions(spark.createDataFrame([("2026-03-06", "09:30", "16:00"), ("2026-03-09", "0930", "1600")], "date string, open string, close string"))
    assert [str(r.open) for r in days.collect()] == ["2026-03-06 14:30:00", "2026-03-09 13:30:00"]
    now = market.clock(days, "2026-03-07 00:00:00").first()
    assert not now.is_open and str(now.next_open) == "2026-03-09 13:30:00" and str(now.next_close) == "2026-03-09 20:00:00"
    assert market.codes(spark.createDataFrame([({"V": "IEX"},)], "m map<string,string>"), "m").first() == ("V", "IEX")
