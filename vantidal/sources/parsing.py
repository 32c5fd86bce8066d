"""Vendor text as columns: instants, durations, wall-clock times, option symbols, tickers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantidal.functions.timeframes import BAR_ZONE


def instant(text: Column) -> Column:
    """RFC 3339 with up to nine fractional digits (cut to microseconds); without an offset the text is refused (null)."""
    cut = F.regexp_replace(F.trim(text), r"(\.\d{6})\d+", "$1")
    ok = cut.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?([Zz]|[+-]\d{2}:?\d{2})$")
    return F.when(ok, F.upper(cut).try_cast("timestamp"))


def wall_clock(day: Column, time: Column, zone: str = BAR_ZONE) -> Column:
    """A day and HH:MM in a zone as an instant."""
    return F.to_utc_timestamp(F.concat_ws(" ", day.cast("string"), time).try_cast("timestamp"), zone)


def duration_seconds(text: Column) -> Column:
    """An ISO-8601 duration of weeks to seconds as seconds; null for other text."""
    shape = r"^P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    parts = [F.coalesce(F.nullif(F.regexp_extract(text, shape, i), F.lit("")).cast("double"), F.lit(0.0)) * k for i, k in enumerate((604800, 86400, 3600, 60, 1), 1)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.when(text.rlike(shape) & text.rlike(r"\d"), total)


def ticker(text: Column) -> Column:
    """Upper case, class shares with a dot; null if it is no symbol."""
    t = F.regexp_replace(F.upper(F.trim(text)), r"[-/ ]([A-Z])$", ".$1")
    return F.when(t.rlike(r"^[A-Z0-9]{1,10}([./][A-Z0-9]{1,10})?$"), t)


def option_symbol(text: Column) -> Column:
    """struct(root, expiration, kind, strike) of a 21-character option symbol (blanks may be left out)."""
    t = F.regexp_replace(F.upper(text), r"\s+", "")
    shape = r"^([A-Z0-9]{1,6}?)(\d{2})(\d{2})(\d{2})([CP])(\d{8})$"
    day = F.concat_ws("-", F.concat(F.lit("20"), F.regexp_extract(t, shape, 2)), F.regexp_extract(t, shape, 3), F.regexp_extract(t, shape, 4))
    out = F.struct(
        F.regexp_extract(t, shape, 1).alias("root"), day.try_cast("date").alias("expiration"),
        F.when(F.regexp_extract(t, shape, 5) == "C", "call").otherwise("put").alias("kind"),
        (F.nullif(F.regexp_extract(t, shape, 6), F.lit("")).cast("double") / 1000).alias("strike"),
    )
    return F.when(t.rlike(shape), out)


def fraction(percent: Column) -> Column:
    """Percent as a fraction; NaN as null."""
    p = percent.cast("double")
    return F.when(~F.isnan(p), F.round(p / 100, 10))


def scaled(value: Column, by: float, digits: int = 6) -> Column:
    v = value.cast("double")
    return F.when(~F.isnan(v), F.round(v * by, digits))
