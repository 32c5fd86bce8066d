"""The window of times that a request means, and bars at its edges.

A start or a lookback, an end that may be a whole day, and a feed that lags become two instants and notes. Bars are stamped
at their start, so the last one may run past the window's end: it is kept, rebuilt from daily bars, or left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantidal.errors import Refusal
from vantidal.functions.timeframes import BAR_ZONE, duration_micros, parts, seconds
from vantidal.operators.relational import absent_map

TICK = timedelta(microseconds=1)


@dataclass(frozen=True)
class Span:
    """Both ends belong to the window. `open_end`: the caller named no end, so the window ends with the newest data."""

    start: datetime
    end: datetime
    latest: datetime
    open_end: bool
    notes: tuple[str, ...] = field(default=())

    def rows(self, df: DataFrame, column: str = "t") -> DataFrame:
        """Rows within the window: a plain predicate that reaches the files."""
        at = F.col(column).cast("timestamp")
        return df.filter((at >= _literal(self.start)) & (at <= _literal(self.end)))


def _literal(t: datetime) -> Column:
    return F.lit(t.astimezone(UTC).isoformat()).cast("timestamp")


def _instant(text: str, what: str) -> datetime:
    clean = text.strip().replace("Z", "+00:00").replace("z", "+00:00")
    try:
        t = datetime.fromisoformat(clean)
    except ValueError:
        raise Refusal("invalid_arguments", f"{what} '{text}' is no date or instant.", "Like 2026-03-02 or 2026-03-02T14:30:00Z.") from None
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def resolve(
    now: datetime, start: str | None = None, end: str | None = None, lookback: str | None = None, default: str = "P1D",
    timeframe: str | None = None, zone: str = "UTC", lag: str = "PT0S",
) -> Span:
    """The window of a request.

    Without a start it reaches back by `lookback` (else by `default`) from its end; for bars of a day or longer to the
    midnight (UTC) of that day. An end that is a date means the whole day in `zone`. No window ends later than the newest
    data: `lag` before now.
    """
    latest = now - timedelta(microseconds=duration_micros(lag))
    notes, upto = [], None
    if start and lookback:
        raise Refusal("invalid_arguments", "A window has a start or a lookback, not both.")
    if end:
        upto = _instant(end, "end")
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", end.strip()):
            following = date.fromisoformat(end.strip()) + timedelta(days=1)
            upto = datetime.combine(following, time(0), ZoneInfo(zone)).astimezone(UTC) - TICK
            notes.append(f"the window takes in the whole of {end.strip()} ({zone})")
        if upto > latest:
            upto = latest
            notes[:] = [f"the window ends with the newest data, {latest.isoformat()}"]
    last = upto or latest
    if start:
        first = _instant(start, "start")
    else:
        try:
            first = last - timedelta(microseconds=duration_micros(lookback or default))
        except OverflowError:
            raise Refusal("invalid_arguments", f"{lookback or default} reaches back too far.") from None
        if timeframe and parts(timeframe)[1] in ("d", "w", "mo"):
            first = first.astimezone(UTC).replace(hour=0, minute=0, second=0, microsecond=0)
    if first >= last:
        raise Refusal("invalid_arguments", f"The window's start ({first.isoformat()}) isn't before its end ({last.isoformat()}).")
    return Span(first.astimezone(UTC), last.astimezone(UTC), latest.astimezone(UTC), upto is None, tuple(notes))


# --- Bars ----------------------------------------------------------------------------------------


def bar_start(ts: Column, timeframe: str, zone: str = "UTC") -> Column:
    """When the bar that holds an instant starts: minutes and hours count from the epoch, longer ones begin at a midnight of
    the zone, weeks on Mondays, months from January."""
    n, unit = parts(timeframe)
    if unit in ("min", "h"):
        width = seconds(timeframe) * 1_000_000
        return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(width)))
    local = F.from_utc_timestamp(ts, zone)
    day = F.date_trunc({"d": "day", "w": "week", "mo": "month"}[unit], local)
    if unit == "mo" and n > 1:
        day = F.add_months(day.cast("date"), -F.pmod(F.month(day) - 1, F.lit(n))).cast("timestamp")
    return F.to_utc_timestamp(day, zone)


def bar_end(ts: Column, timeframe: str, zone: str = "UTC") -> Column:
    """When a bar that starts at an instant closes: days, weeks and months pass on the zone's calendar."""
    n, unit = parts(timeframe)
    if unit in ("min", "h"):
        return F.timestamp_micros(F.unix_micros(ts) + F.lit(seconds(timeframe) * 1_000_000))
    local = F.from_utc_timestamp(ts, zone)
    step = F.make_ym_interval(F.lit(0), F.lit(n)) if unit == "mo" else F.make_dt_interval(F.lit(n * 7 if unit == "w" else n))
    return F.to_utc_timestamp(local + step, zone)


@dataclass
class Edges:
    """Bars without what happened after the window's end, and each changed or unfinished bar with what was done."""

    bars: DataFrame
    touched: DataFrame  #: key, t and edge: current (still growing), rebuilt or left out


def cap_last_bars(
    bars: DataFrame, span: Span, timeframe: str, trades: DataFrame | None = None, days: DataFrame | None = None, key: str = "ticker",
    time_column: str = "t", zone: str = BAR_ZONE,
) -> Edges:
    """Bars whose period runs past the window's end lose what lies beyond it.

    A bar that runs past an end before the newest data is whole as it is if nothing trades between the end and its close
    (`trades`: key and time; without it anything may trade). Otherwise a bar of a week or longer is rebuilt from the
    daily bars (`days`) of the whole days before the end, without a vwap, and other bars are left out. Bars that run
    past the newest data are current: later trades would change them.
    """
    t = F.col(time_column).cast("timestamp")
    after, latest = _literal(span.end + TICK), _literal(span.latest)
    closes = bar_end(t, timeframe, zone)
    marked = bars.withColumn("__close", closes).withColumn("__over", closes > after)
    if span.open_end or span.end >= span.latest:
        touched = marked.filter("__over").select(key, time_column, F.lit("current").alias("edge"))
        return Edges(bars, touched)
    over = marked.filter("__over")
    if trades is None:
        busy = over.select(key).distinct()
    else:  # a key's only bar over the end is its last
        late = trades.select(F.col(key), F.col(time_column).cast("timestamp").alias("__t")).filter((F.col("__t") > _literal(span.end)) & (F.col("__t") <= latest))
        busy = over.select(key, "__close").join(late, key).filter(F.col("__t") <= F.col("__close")).select(key).distinct()
    cut, quiet = over.join(busy, key, "left_semi"), over.join(busy, key, "left_anti")
    day = (span.end + TICK).astimezone(ZoneInfo(zone)).replace(hour=0, minute=0, second=0, microsecond=0)
    made = None
    if days is not None and parts(timeframe)[1] in ("w", "mo"):
        d = days.select(
            F.col(key), F.col(time_column).cast("timestamp").alias("__d"), *(F.col(c).alias(f"__{c}") for c in ("open", "high", "low", "close", "volume", "trade_count") if c in days.columns)
        ).filter(F.col("__d") < _literal(day))
        has = set(d.columns)
        sums = d.join(cut.select(key, t.alias("__s")), key).filter(F.col("__d") >= F.col("__s")).groupBy(key).agg(
            F.min_by("__open", "__d").alias("open"), F.max("__high").alias("high"), F.min("__low").alias("low"), F.max_by("__close", "__d").alias("close"), F.sum("__volume").alias("volume"),
            *([F.when(F.count("__trade_count") == F.count("*"), F.sum("__trade_count")).alias("trade_count")] if "__trade_count" in has else []),
        )
        kept = [c for c in bars.columns if c not in ("open", "high", "low", "close", "volume", "trade_count", "vwap", "absent")]
        made = cut.select(*kept).join(sums, key)
        if "vwap" in bars.columns:
            made = made.withColumn("vwap", F.lit(None).cast(bars.schema["vwap"].dataType))
        if "trade_count" in bars.columns and "trade_count" not in made.columns:
            made = made.withColumn("trade_count", F.lit(None).cast(bars.schema["trade_count"].dataType))
        if "absent" in bars.columns:
            made = made.withColumn("absent", absent_map([c for c in ("vwap", "trade_count") if c in bars.columns], "insufficient_data"))
        made = made.select(*(F.col(c).cast(bars.schema[c].dataType).alias(c) for c in bars.columns))
    whole = marked.filter("NOT __over").select(*bars.columns).unionByName(quiet.select(*bars.columns))
    said = quiet.filter(F.col("__close") > latest).select(key, time_column, F.lit("current").alias("edge"))
    if made is None:
        return Edges(whole, said.unionByName(cut.select(key, time_column, F.lit("left out").alias("edge"))))
    rebuilt = made.select(key, time_column, F.lit("rebuilt").alias("edge"))
    gone = cut.join(made.select(key), key, "left_anti").select(key, time_column, F.lit("left out").alias("edge"))
    return Edges(whole.unionByName(made), said.unionByName(rebuilt).unionByName(gone))
