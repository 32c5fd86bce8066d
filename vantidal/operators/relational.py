"""Relational operators that Spark SQL lacks or orders differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantidal.errors import Refusal


def ordered(df: DataFrame, *columns: str | tuple[str, str]) -> DataFrame:
    """Sorted with nulls last in both directions: names, or pairs of a name and asc or desc."""
    keys = [(c, "asc") if isinstance(c, str) else c for c in columns]
    return df.orderBy(*(F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in keys))


def with_ties(df: DataFrame, n: int, *columns: tuple[str, str]) -> DataFrame:
    """The first n rows and all that tie with the nth, by pairs of a name and asc or desc (nulls last).

    A distributed top-n finds the nth row's key; rows with the same key are then taken by a filter.
    """
    if n < 1:
        return df.limit(0)
    top = ordered(df, *columns).limit(n)
    if top.count() < n:
        return df
    back = [F.col(c).asc_nulls_first() if way == "desc" else F.col(c).desc_nulls_first() for c, way in columns]
    last = top.orderBy(*back).select(*(c for c, _ in columns)).first()  # one row
    edge = F.lit(True)
    for c, _ in columns:
        edge &= F.col(c).eqNullSafe(F.lit(last[c]))
    return top.filter(~edge).unionByName(df.filter(edge))


def top_per_key(df: DataFrame, key: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first n rows of each key (Spark keeps n rows a key before the shuffle), numbered from 1."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def latest_row(df: DataFrame, key: list[str], time: str, *tie: str) -> DataFrame:
    """The newest row of each key, by one combinable aggregate."""
    rest = [c for c in df.columns if c not in key]
    order = F.struct(F.col(time), *(F.col(t) for t in tie))
    out = df.filter(F.col(time).isNotNull()).groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return out.select(*[F.col(c) if c in key else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def limit_percent(df: DataFrame, percent: float, *order: Column) -> DataFrame:
    """The first share of rows in an order; the number of rows is counted first."""
    if not 0 <= percent <= 100:
        raise Refusal("invalid_arguments", "A percentage is between 0 and 100.")
    return df.orderBy(*order).limit(int(df.count() * percent / 100))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A uniform sample of n rows that is the same on every run: those of the least seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)


def union_by_name(*frames: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows of all frames; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.distinct() if distinct else out


def lookup(df: DataFrame, dim: DataFrame, key: list[str], columns: list[str], code: str = "not_found") -> DataFrame:
    """A left join that tells why a looked-up value is missing: `absent` maps each null column to the code.

    The planner broadcasts the dimension where its size allows that.
    """
    out = df.join(dim.select(*key, *columns, F.lit(True).alias("__hit")), key, "left")
    return out.withColumn("absent", absent_map(columns, code)).drop("__hit")


def absent_map(columns: list[str], code: str) -> Column:
    """A map from each null column to why it is null."""
    entries = F.array(*(F.struct(F.lit(c).alias("key"), F.when(F.col(c).isNull(), F.lit(code)).alias("value")) for c in columns))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def value_counts(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """How often each value that isn't null occurs in each group: a histogram as rows, so no group is gathered."""
    return df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))


def entropy(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The entropy in bits of a column's values in each group; 0 without values."""
    counts = value_counts(df, by, column).groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    bits = F.log2("t") - F.col("s") / F.col("t")
    return df.select(*by).distinct().join(counts.select(*by, bits.alias("entropy")), by, "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))


def column_summary(df: DataFrame) -> DataFrame:
    """column, kind, nulls, least and greatest (as text, cut to 64 characters) of every column, in one pass.

    Nested columns have no extremes.
    """
    flat = [f for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant", "binary")]
    names = {f.name for f in flat}
    aggs = []
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(F.when(c.isNull(), 1)).alias(f"n{i}"))
        for mark, agg in (("a", F.min), ("z", F.max)):
            x = agg(c).cast("string") if f.name in names else F.lit(None).cast("string")
            aggs.append(F.substring(x, 1, 64).alias(f"{mark}{i}"))
    row = df.agg(*aggs)
    cells = F.array(*(
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("kind"),
                 F.col(f"n{i}").alias("nulls"), F.col(f"a{i}").alias("least"), F.col(f"z{i}").alias("greatest"))
        for i, f in enumerate(df.schema)
    ))
    return row.select(F.explode(cells).alias("c")).select("c.*")
