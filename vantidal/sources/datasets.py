"""Point-in-time datasets: one reader that filters, cuts at a knowledge time, maps, orders and caps.

A dataset is a table of versions. What a tool of its own would do for it is a `Dataset`: its key, time,
order, percent columns, and the filters that it takes. Distinctive rules stand below as functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantidal.errors import Refusal
from vantidal.operators.vintages import read_vintages
from vantidal.sources.parsing import fraction, scaled

#: Rows of a fetch at most, unless a caller says otherwise.
MOST_ROWS = 50_000


@dataclass(frozen=True)
class Dataset:
    key: tuple[str, ...]
    time: str | None = None
    order: tuple[tuple[str, str], ...] = ()  #: pairs of a column and asc or desc
    percents: tuple[str, ...] = ()  #: columns in percent, given as fractions
    scales: dict[str, float] = field(default_factory=dict)
    search: tuple[str, ...] = ()  #: text columns that `q` is looked for in, whatever the case
    ranks: dict[str, tuple[str, ...]] = field(default_factory=dict)  #: columns ordered by a given list
    known: str = "knowledge_time"


@dataclass
class Fetched:
    rows: DataFrame
    most: int

    def truncated(self) -> bool:
        """Whether there are more rows than the cap."""
        return self.rows.limit(self.most + 1).count() > self.most

    def capped(self) -> DataFrame:
        return self.rows.limit(self.most)


def read_dataset(
    df: DataFrame, spec: Dataset, as_of: str | None = None, vintages: str = "latest", start: str | None = None, end: str | None = None,
    q: str | None = None, most: int = MOST_ROWS, **equal: object,
) -> Fetched:
    """A dataset's rows as known at `as_of`, in its order. Filters are plain predicates that reach the files."""
    known = spec.known if spec.known in df.columns else None
    if known:
        rows = read_vintages(df, list(spec.key), as_of, vintages, spec.time, start, end, known, **equal)
    elif as_of is not None:
        raise Refusal("not_point_in_time", "The dataset has no knowledge time.", "Leave out as_of.")
    else:
        rows = read_vintages(df, list(spec.key), None, "all", spec.time, start, end, **equal)
    if q:
        if not spec.search:
            raise Refusal("invalid_arguments", "The dataset has no text to search.")
        rows = rows.filter(F.lower(F.concat_ws("\n", *spec.search)).contains(q.lower()))
    rows = rows.withColumns({c: fraction(F.col(c)) for c in spec.percents} | {c: scaled(F.col(c), k) for c, k in spec.scales.items()})
    order = [*((c, "asc") for c in spec.ranks), *spec.order]
    if order:
        rows = rows.orderBy(*(
            (place.desc_nulls_last() if way == "desc" else place.asc_nulls_last())
            for c, way in order
            for place in [ranked(c, spec.ranks[c]) if c in spec.ranks else F.col(c)]
        ))
    return Fetched(rows, most)


def ranked(column: str, given: tuple[str, ...]) -> Column:
    """A value's place in a given list; others come last."""
    return F.nullif(F.array_position(F.array(*(F.lit(g) for g in given)), F.col(column)), F.lit(0))


def open_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- Distinctive rules -------------------------------------------------------------------------


def limit_groups(df: DataFrame, group: str, order: Column, n: int) -> DataFrame:
    """All rows of the first n groups (filings, reports) in an order of the groups' own."""
    first = df.groupBy(group).agg(F.max(order).alias("__at")).orderBy(F.col("__at").desc_nulls_last(), F.col(group)).limit(n)
    return df.join(F.broadcast(first.select(group)), group, "left_semi")  # n ids at most


def standing_portfolio(df: DataFrame, period: str, filed: str, accession: str, amendment: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Holdings that stand for each period: the latest restatement replaces what was filed before it; amendments
    that add holdings count if they were filed after it; without a restatement everything counts."""
    kind = F.upper(F.coalesce(F.col(amendment), F.lit("")))
    when = F.struct(F.col(filed), F.col(accession))
    keys = [*by, period]
    last = df.filter(kind == "RESTATEMENT").groupBy(*keys).agg(F.max(when).alias("__last"))
    rows = df.join(last, keys, "left")
    keep = F.col("__last").isNull() | (F.col(accession) == F.col(f"__last.{accession}")) | ((kind == "NEW HOLDINGS") & (when > F.col("__last")))
    return rows.filter(keep).drop("__last")


def newest_report(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """All rows of each key's newest report, by the greatest of the given columns in turn."""
    top = df.groupBy(*key).agg(F.max(F.struct(*order)).alias("__top"))
    return df.join(top, key).filter(F.struct(*order) == F.col("__top")).drop("__top")


def security_class(kind: Column, term: Column, indexed: Column, results: Column, high_yield: Column) -> Column:
    """The class of an auctioned security: indexed ones are TIPS; notes with results but no high yield FRNs; bills
    whose term is in days CMBs."""
    return (
        F.when(indexed, "TIPS").when((kind == "Note") & results.isNotNull() & high_yield.isNull(), "FRN")
        .when((kind == "Bill") & F.lower(term).contains("day"), "CMB").otherwise(kind)
    )


def published_union(*frames: DataFrame, key: list[str], label: str = "market", names: tuple[str, ...] = ()) -> DataFrame:
    """Rows of several publications together, each marked with its name; a key's repeated rows in one count once."""
    out = None
    for name, f in zip(names or [str(i) for i in range(len(frames))], frames, strict=True):
        one = f.dropDuplicates(key).withColumn(label, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def merged_publications(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Two publications of the same rows: values of the first, completed by the second's."""
    rest = [c for c in dict.fromkeys([*first.columns, *second.columns]) if c not in key]
    a = first.select(*key, *(F.col(c).alias(f"a_{c}") if c in first.columns else F.lit(None).alias(f"a_{c}") for c in rest))
    b = second.select(*key, *(F.col(c).alias(f"b_{c}") if c in second.columns else F.lit(None).alias(f"b_{c}") for c in rest))
    return a.join(b, key, "full").select(*key, *(F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in rest))


def frame_ranks(df: DataFrame, value: str, by: list[str], way: str = "desc") -> DataFrame:
    """One concept across companies: rank and share within a period; equal values share a rank."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last() if way == "desc" else F.col(value).asc_nulls_last())
    return df.withColumn("rank", F.rank().over(w)).withColumn("percentile", F.percent_rank().over(w))


def growth(df: DataFrame, key: list[str], time: str, value: str, months: int = 12) -> DataFrame:
    """A value against the one so many months before: a join on the shifted month, so gaps stay gaps."""
    past = df.select(*key, F.add_months(time, months).alias(time), F.col(value).alias("__past"))
    out = df.withColumn(time, F.col(time).cast("date")).join(past, [*key, time], "left")
    return out.withColumn("growth", F.try_divide(F.col(value) - F.col("__past"), F.abs(F.col("__past")))).drop("__past")
