"""What every series operator starts from: rows (s, ts, v) of a table, with what was left out counted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantidal.errors import Refusal
from vantidal.functions.numeric import finite

#: The name of the only series of a table without a series column.
ALL = "_all"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass
class Series:
    """A table and its roles. Without names, the time is the only timestamp (or `t`, or `event_time`)."""

    df: DataFrame
    time: str | None = None
    series: str | None = None
    value: str | None = None
    label: str = "the table"
    notes: list[str] = field(default_factory=list)
    spread: str | None = None  #: a timeframe by which long series are cut, so that one series is the work of many tasks

    def __post_init__(self) -> None:
        fields = {f.name: f.dataType for f in self.df.schema}
        for c in (self.time, self.series, self.value):
            if c is not None and c not in fields:
                raise Refusal("unknown_column", f"{self.label} has no column '{c}'.", f"It has {', '.join(fields)}.")
        if self.time is None:
            found = [c for c, k in fields.items() if isinstance(k, TIMES)]
            named = [c for c in ("t", "event_time") if c in found]
            if len(found) == 1 or named:
                self.time = found[0] if len(found) == 1 else named[0]
        if self.time is None or not isinstance(fields[self.time], TIMES):
            raise Refusal("not_time_series", f"{self.label} has no single time column.", "Name it.")

    def kind(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType

    def value_column(self) -> str:
        """The value's column: a number that is named, or the only one."""
        if self.value is None:
            numbers = [f.name for f in self.df.schema if isinstance(f.dataType, NUMERIC) and f.name != self.series]
            if len(numbers) != 1:
                raise Refusal("column_required", f"{self.label} has {len(numbers)} numeric columns.", "Name the value's.")
            return numbers[0]
        if not isinstance(self.kind(self.value), NUMERIC):
            raise Refusal("not_numeric", f"'{self.value}' of {self.label} is no number.")
        return self.value

    def key(self) -> Column:
        return F.col(self.series).cast("string") if self.series else F.lit(ALL)

    def clock(self) -> Column:
        return F.col(self.time).cast("timestamp")

    def points(self, *, positive: bool = False) -> DataFrame:
        """s, ts, v of the rows with a time, a series and a finite (and positive) value."""
        v = F.col(self.value_column()).cast("double")
        keep = F.col(self.time).isNotNull() & v.isNotNull() & finite(v)
        if self.series:
            keep &= F.col(self.series).isNotNull()
        if positive:
            keep &= v > 0
        return self.df.filter(keep).select(self.key().alias("s"), self.clock().alias("ts"), v.alias("v"))

    def skipped(self, *, positive: bool = False) -> dict[str, int]:
        """How many rows `points` leaves out, by reason; one pass."""
        v = F.col(self.value_column()).cast("double")
        timed = F.col(self.time).isNotNull()
        there = timed & v.isNotNull()
        parts = {
            "no_time": ~timed,
            "no_value": timed & v.isNull(),
            "non_finite": there & ~finite(v),
            "no_series": there & F.col(self.series).isNull() if self.series else F.lit(False),
            "not_positive": there & finite(v) & (v <= 0) if positive else F.lit(False),
        }
        row = self.df.agg(*(F.count(F.when(c, 1)).alias(k) for k, c in parts.items())).first()
        return row.asDict()


def check_unique_times(points: DataFrame, label: str = "the table") -> None:
    """Refuse two values of one series at one time: the order of returns would be unclear. An eager pass, for operators
    whose plan doesn't see neighbours anyway (see `once`)."""
    if not points.groupBy("s", "ts").count().filter("count > 1").isEmpty():
        raise Refusal("duplicate_timestamps", f"{label} has several values of a series at one time.", "Name a series column or remove them.")


def once(value: Column, ts: Column, before: Column, label: str = "the table") -> Column:
    """The value; the query fails where the time is the one before it. No pass of its own."""
    said = F.raise_error(F.lit(f"duplicate_timestamps: {label} has several values of a series at one time. Name a series column or remove them."))
    return F.when(ts == before, said.cast("double")).otherwise(value)


# --- Long series ---------------------------------------------------------------------------------

#: Rows of a series that one task may hold before a table of a single series is cut by time.
LONG = 1_000_000


def spread_of(inp: Series, points: DataFrame) -> str | int | None:
    """By what series are cut: what the caller says; a width in microseconds for a long table without a series column."""
    if inp.spread is not None or inp.series is not None:
        return inp.spread
    row = points.agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("z")).first()
    return None if row.n <= LONG else max(1, (row.z - row.a) // -(-row.n // LONG))


def piece(spread: str | int, ts: Column) -> Column:
    """The number of the piece that an instant falls in."""
    from vantidal.functions.timeframes import seconds

    width = spread if isinstance(spread, int) else seconds(spread) * 1_000_000
    return F.floor(F.unix_micros(ts) / F.lit(width)).cast("long")


def with_before(points: DataFrame, spread: str | int | None, label: str = "the table") -> DataFrame:
    """The points with v0 and t0, the value and time before each in its series (null for the first), times being unique.

    A cut series is ordered piece by piece; the last row of the pieces before comes from a small table, one row a piece.
    """
    if spread is None:
        w = Window.partitionBy("s").orderBy("ts")
        out = points.withColumn("t0", F.lag("ts").over(w)).withColumn("v0", F.lag("v").over(w))
    else:
        cut = points.withColumn("p", piece(spread, F.col("ts")))
        ends = cut.groupBy("s", "p").agg(F.max(F.struct("ts", "v")).alias("e"))
        ends = ends.select("s", "p", F.lag("e").over(Window.partitionBy("s").orderBy("p")).alias("e"))
        w = Window.partitionBy("s", "p").orderBy("ts")
        rows = cut.withColumn("t1", F.lag("ts").over(w)).withColumn("v1", F.lag("v").over(w)).join(ends, ["s", "p"])
        out = rows.select("s", "ts", "v", F.coalesce("t1", "e.ts").alias("t0"), F.coalesce("v1", "e.v").alias("v0"))
    return out.withColumn("v0", once(F.col("v0"), F.col("ts"), F.col("t0"), label))


def in_blocks(rows: DataFrame, key: str, time: str, spread: str | int, window: int) -> DataFrame:
    """The rows with `block` and `own`: a rolling window of `window` rows over (key, block) sees what it would see over the
    whole series in the rows that are `own`. Blocks have equal numbers of rows and the last rows of the block before."""
    cut = rows.withColumn("p", piece(spread, F.col(time)))
    sizes = cut.groupBy(key, "p").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(key).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(key, "p", before.alias("seen"))
    number = F.row_number().over(Window.partitionBy(key, "p").orderBy(time)) - 1
    numbered = cut.withColumn("n", number).join(sizes, [key, "p"]).withColumn("n", F.col("n") + F.col("seen"))
    size = max(100_000, 10 * window)
    own, later = F.floor(F.col("n") / size), F.floor((F.col("n") + window - 1) / size)
    out = numbered.withColumn("block", F.explode(F.array_distinct(F.array(own, later)))).withColumn("own", F.col("block") == own)
    return out.drop("p", "n", "seen")


def single_timeframe(df: DataFrame, column: str = "timeframe") -> str | None:
    """The bars' only timeframe; None without such a column or value; several are refused."""
    if column not in df.columns:
        return None
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(3).collect()]
    if len(found) > 1:
        raise Refusal("mixed_timeframes", f"The bars have several timeframes ({', '.join(sorted(found))}).", "Keep one.")
    return found[0] if found else None
