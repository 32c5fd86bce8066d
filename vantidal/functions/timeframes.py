"""Timeframes (15min, 4h, 1d, 1w, 3mo), durations, buckets and the ends of bars."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantidal.errors import Refusal

#: The counts that each unit of a timeframe allows.
ALLOWED = {"min": range(1, 60), "h": range(1, 24), "d": (1,), "w": (1,), "mo": (1, 2, 3, 4, 6, 12)}
SECONDS = {"min": 60, "h": 3600, "d": 86_400, "w": 604_800, "mo": 2_592_000}  #: a month counts 30 days
PATTERN = r"^([1-9]|[1-5][0-9])min$|^([1-9]|1[0-9]|2[0-3])h$|^1d$|^1w$|^(1|2|3|4|6|12)mo$"
#: Buckets of days and shorter count from a Monday, months from a January.
ORIGIN_MICROS = int(datetime(2000, 1, 3, tzinfo=UTC).timestamp()) * 1_000_000
#: The zone in which stock bars of a day and longer begin at midnight.
BAR_ZONE = "America/New_York"


def parts(tf: str) -> tuple[int, str]:
    m = re.fullmatch(r"(\d+)(min|h|d|w|mo)", tf or "")
    if not m or int(m[1]) not in ALLOWED[m[2]]:
        raise Refusal("invalid_arguments", f"'{tf}' is no timeframe.", "Use Nmin, Nh, 1d, 1w or Nmo.")
    return int(m[1]), m[2]


def seconds(tf: str) -> int:
    n, unit = parts(tf)
    return n * SECONDS[unit]


def nests(source: str, target: str) -> bool:
    """Whether each bucket of the coarser `target` holds whole bars of `source`."""
    (n, unit), (m, to) = parts(source), parts(target)
    within_day = unit in ("min", "h")
    if to in ("min", "h"):
        return within_day and seconds(target) % seconds(source) == 0
    if within_day:
        return SECONDS["d"] % seconds(source) == 0
    return unit == "d" if to == "w" else unit == "d" or unit == "mo" and m % n == 0


def check_target(source: str | None, target: str) -> None:
    """Refuse a target that isn't coarser than the bars, or into which they don't nest."""
    parts(target)
    if source is None:
        return
    if seconds(target) <= seconds(source):
        raise Refusal("timeframe_not_coarser", f"{target} is not coarser than the bars' {source}.")
    if not nests(source, target):
        raise Refusal("timeframe_not_nested", f"{source} bars don't fit whole into {target} buckets.")


def duration_micros(text: str) -> int:
    """An ISO-8601 duration of weeks to seconds, in microseconds."""
    m = re.fullmatch(r"P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,6}))?S)?)?", text or "")
    if not m or not any(m.groups()) or text.endswith("T"):
        raise Refusal("invalid_tolerance", f"'{text}' is no duration of weeks, days, hours, minutes and seconds.", "Like PT5M or P1D.")
    w, d, h, minute, s, fraction = m.groups()
    whole = sum(int(x or 0) * k for x, k in zip((w, d, h, minute, s), (604_800, 86_400, 3600, 60, 1), strict=True))
    return whole * 1_000_000 + int((fraction or "0").ljust(6, "0"))


def time_bucket(tf: str, ts: Column) -> Column:
    """The start of the bucket that an instant falls in, in UTC; floors before the origin too."""
    n, unit = parts(tf)
    ts = ts.cast("timestamp")
    if unit == "mo":
        index = F.year(ts) * 12 + F.month(ts) - 1 - 2000 * 12
        first = index - F.pmod(index, F.lit(n)) + 2000 * 12
        return F.make_timestamp(F.floor(first / 12).cast("int"), (F.pmod(first, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    width = seconds(tf) * 1_000_000
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros - F.lit(ORIGIN_MICROS), F.lit(width)))


def span_end(ts: Column, span: Column) -> Column:
    """When a bar ends that starts at `ts` and covers `span` (a column of timeframes).

    Minutes and hours are added as they are. Days, weeks and months are added on the calendar of the zone in
    which the bar starts at midnight: New York, else UTC, else the later of both. Null for other spans.
    """
    n = F.regexp_extract(span, r"^(\d+)", 1)
    n = F.when(n != "", n).cast("int")
    unit = F.regexp_extract(span, r"([a-z]+)$", 1)
    zero = F.lit(0)

    def later(t: Column) -> Column:
        days = F.when(unit == "d", n).when(unit == "w", 7 * n).otherwise(zero)
        months = F.when(unit == "mo", n).otherwise(zero)
        return t + F.make_ym_interval(zero, months) + F.make_dt_interval(days)

    local = F.from_utc_timestamp(ts, BAR_ZONE)
    in_utc, in_zone = later(ts), F.to_utc_timestamp(later(local), BAR_ZONE)
    exact = ts + F.when(unit == "min", F.make_dt_interval(zero, zero, n)).otherwise(F.make_dt_interval(zero, n))
    long = (
        F.when(local == F.date_trunc("day", local), in_zone)
        .when(ts == F.date_trunc("day", ts), in_utc)
        .otherwise(F.greatest(in_utc, in_zone))
    )
    return F.when(span.rlike(PATTERN), F.when(unit.isin("min", "h"), exact).otherwise(long))


def default_periods_per_year(tf: str, *, every_day: bool = False, extended: bool = False) -> float | None:
    """Bars a year: 252 sessions of 6.5 hours (16 with extended hours), or 365 days of 24 hours; None without a default."""
    n, unit = parts(tf)
    days, minutes = (365, 1440) if every_day else (252, 960 if extended else 390)
    if unit == "min":
        return days * minutes / n
    if unit == "h":
        return days * minutes / 60 / n if every_day or n == 1 else None
    return {"1d": float(days), "1w": 52.0, "1mo": 12.0}.get(tf)
