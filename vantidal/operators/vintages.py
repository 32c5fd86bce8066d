"""Point-in-time reads: rows carry the time at which they became known; later versions replace earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantidal.errors import Refusal


def as_known(df: DataFrame, as_of: str | Column, known: str = "knowledge_time") -> DataFrame:
    """The versions known at an instant; rows without a knowledge time were never known."""
    at = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return df.filter(F.col(known) <= at)


def latest_versions(df: DataFrame, key: list[str], known: str = "knowledge_time", tie: list[str] = ()) -> DataFrame:
    """The newest version of each key: one combinable aggregate, no sort of a key's versions.

    Ties of the knowledge time go to the greater `tie` columns. Rows without knowledge time count only where a
    key has no other.
    """
    rest = [c for c in df.columns if c not in key]
    order = F.struct(F.col(known).isNotNull(), F.col(known), *(F.col(c) for c in tie))
    out = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return out.select(*[F.col(c) if c in key else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def read_vintages(
    df: DataFrame, key: list[str], as_of: str | None = None, vintages: str = "latest", time: str | None = None,
    start: str | None = None, end: str | None = None, known: str = "knowledge_time", tie: list[str] = (), **equal: object,
) -> DataFrame:
    """A dataset as it was known: filters, the window of times, the as-of cut, then the newest version or all.

    All filters are plain predicates, so they reach the scan. `equal` takes a value or a list for a column.
    """
    if vintages not in ("latest", "all"):
        raise Refusal("invalid_arguments", "vintages is latest or all.")
    for c, v in equal.items():
        if c not in df.columns:
            raise Refusal("unknown_column", f"There is no column '{c}'.")
        df = df.filter(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v))
    if time is not None:
        if start is not None:
            df = df.filter(F.col(time) >= F.lit(start).cast("timestamp"))
        if end is not None:
            df = df.filter(F.col(time) <= F.lit(end).cast("timestamp"))
    if as_of is not None:
        df = as_known(df, as_of, known)
    return latest_versions(df, key, known, tie) if vintages == "latest" else df


def revisions(df: DataFrame, key: list[str], value: str, known: str = "knowledge_time") -> DataFrame:
    """For each key: versions, first and last value, and how much the value moved."""
    at = F.col(known)
    out = df.filter(at.isNotNull()).groupBy(*key).agg(
        F.count("*").alias("versions"), F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value")
    )
    return out.withColumn("moved", F.col("last_value") - F.col("first_value"))


def superseded(df: DataFrame, newer: DataFrame, key: list[str], known: str = "knowledge_time") -> tuple[DataFrame, DataFrame]:
    """Rows of `df` without and with a newer row of the same key in `newer` (anti and semi join)."""
    latest = newer.groupBy(*key).agg(F.max(known).alias("__newest"))
    on = [df[c] == latest[c] for c in key] + [df[known] < latest["__newest"]]
    return df.join(latest, on, "left_anti"), df.join(latest, on, "left_semi")
