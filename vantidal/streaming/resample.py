"""Resampling of streams: the batch operator's rule over event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantidal.functions.timeframes import parts


def resample_stream(ticks: DataFrame, timeframe: str, time: str, series: str, value: str, tie: str, late: str = "1 hour") -> DataFrame:
    """Open, high, low, close, volume and count by window; rows later than the watermark are dropped by Spark.

    Weeks begin on Mondays as in the batch operator. Months have no fixed width, so they can't be streamed.
    """
    n, unit = parts(timeframe)
    if unit == "mo":
        raise ValueError("months can't be windows of a stream")
    width = f"{n} {'minute' if unit == 'min' else {'h': 'hour', 'd': 'day', 'w': 'week'}[unit]}s"
    # Buckets count from Monday 2000-01-03, Spark's windows from 1970-01-01, a Thursday.
    offset = {"w": "4 days", "d": "0 days"}.get(unit)
    if offset is None:
        from vantidal.functions.timeframes import ORIGIN_MICROS, seconds

        offset = f"{ORIGIN_MICROS // 1_000_000 % seconds(timeframe)} seconds"
    key = F.struct(time, tie)
    kept = ticks.filter(F.col(value).isNotNull()).withWatermark(time, late)
    out = kept.groupBy(F.window(time, width, width, offset).alias("w"), F.col(series).alias("series")).agg(
        F.min_by(value, key).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, key).alias("close"),
        F.sum(value).alias("volume"), F.count("*").alias("n"),
    )
    return out.select("series", F.col("w.start").alias("t"), "open", "high", "low", "close", "volume", "n")
