"""As-of joins that never look ahead: union and window, so a key is sorted once and nothing is paired.

Both sides are tagged and sorted together; a window carries the newest right row to each left row. Work
and memory are linear in the rows of both sides; keys spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantidal.errors import Refusal
from vantidal.functions.timeframes import duration_micros, span_end
from vantidal.operators.points import LONG, piece


def dominant(right: DataFrame, by: list[str], time: str, known: str) -> DataFrame:
    """Right rows that are the newest known of their time when they become known.

    A late revision of an old time never displaces a newer time; of rows known at once the newest time counts.
    """
    order = Window.partitionBy(*by).orderBy(known).rangeBetween(Window.unboundedPreceding, 0)
    pick = Window.partitionBy(*by, known).orderBy(F.col(time).desc_nulls_last())
    kept = right.withColumn("__newest", F.max(time).over(order)).filter(F.col(time) >= F.col("__newest"))
    return kept.withColumn("__n", F.row_number().over(pick)).filter("__n = 1").drop("__newest", "__n")


def _width(both: DataFrame) -> int | None:
    """Microseconds by which rows without a key are cut; None for a table that one task may hold."""
    row = both.agg(F.count("*").alias("n"), F.unix_micros(F.min("__at")).alias("a"), F.unix_micros(F.max("__at")).alias("z")).first()
    return None if row.n <= LONG else max(1, (row.z - row.a) // -(-row.n // LONG))


def asof_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[tuple[str, str]] = (), direction: str = "backward",
    tolerance: str | None = None, right_columns: list[str] | None = None, suffix: str = "_right", match: str | None = None, strict: bool = False,
    spread: str | None = None, match_name: str = "matched_t",
) -> DataFrame:
    """Every left row with the right row of the nearest clock at or before it (forward: at or after it).

    `by` pairs key columns; `match` is the right clock that is compared (the time if not given). Left rows with a
    null time or key stay, without a match, and so do left rows that nothing matches. Extra column: matched_t (or `match_name`),
    the matched row's time. Of right rows with equal keys and clocks the one with the greatest row wins. `strict` leaves out
    right rows of the same clock. `spread` is a timeframe by which keys with many rows are cut: its pieces are matched apart,
    and the nearest right row of other pieces comes from a table of a row a piece. Without `by` a long table is cut anyhow.
    """
    if direction not in ("backward", "forward"):
        raise Refusal("invalid_arguments", "The direction is backward or forward.")
    limit = duration_micros(tolerance) if tolerance is not None else None
    clock = match or right_time
    lby, rby = [a for a, _ in by], [b for _, b in by]
    for df, names in ((left, [left_time, *lby]), (right, [right_time, clock, *rby, *(right_columns or [])])):
        for c in names:
            if c not in df.columns:
                raise Refusal("unknown_column", f"There is no column '{c}'.", f"There are {', '.join(df.columns)}.")
    taken = right_columns if right_columns is not None else [c for c in right.columns if c not in (right_time, "absent", *rby)]
    if match_name in left.columns:
        raise Refusal("column_collision", f"The left side already has {match_name}.")
    names: dict[str, str] = {}
    for c in taken:
        new = c + suffix if c in left.columns or c == match_name else c
        if new in left.columns or new in names.values():
            raise Refusal("column_collision", f"'{new}' would appear twice.", "Choose another suffix or fewer columns.")
        names[c] = new

    keys = [f"__k{i}" for i in range(len(by))]
    payload = F.struct(F.col(right_time).cast("timestamp").alias("matched_t"), F.col(clock).cast("timestamp").alias("__clock"),
                       *(F.col(c).alias(f"r{i}") for i, c in enumerate(taken)))
    rest = F.struct(*(F.col(c).alias(f"l{i}") for i, c in enumerate(left.columns)))
    ok_left = F.col(left_time).isNotNull()
    ok_right = F.col(clock).isNotNull() & F.col(right_time).isNotNull()
    for c in lby:
        ok_left &= F.col(c).isNotNull()
    for c in rby:
        ok_right &= F.col(c).isNotNull()
    r = right.filter(ok_right).select(
        *(F.col(c).alias(k) for k, c in zip(keys, rby, strict=True)), F.col(clock).cast("timestamp").alias("__at"), F.lit(0).alias("__side"), payload.alias("__r")
    )
    # One row of equal keys and clocks, so that ties have a defined winner and the window sees fewer rows.
    orderable = [c for c in taken if not right.schema[c].dataType.typeName().startswith(("map", "variant"))]
    best = F.struct(F.col("__r.matched_t"), *(F.col(f"__r.r{taken.index(c)}") for c in orderable))
    r = r.groupBy(*keys, "__at", "__side").agg(F.max_by("__r", best).alias("__r"))
    base = left.select(
        *(F.col(c).alias(k) for k, c in zip(keys, lby, strict=True)), F.col(left_time).cast("timestamp").alias("__at"),
        F.lit(1).alias("__side"), rest.alias("__l"), ok_left.alias("__ok"),
    )
    none_r = F.lit(None).cast(r.schema["__r"].dataType)
    both = base.filter("__ok").select(*keys, "__at", "__side", none_r.alias("__r"), "__l").unionByName(
        r.select(*keys, "__at", "__side", "__r", F.lit(None).cast(base.schema["__l"].dataType).alias("__l"))
    )
    # Right rows come before left ones of the same clock where they may match them: backward in ascending order,
    # forward in descending order.
    side = F.col("__side").desc() if strict else F.col("__side").asc()
    order = [F.col("__at").asc(), side] if direction == "backward" else [F.col("__at").desc(), side]
    width: str | int | None = spread
    if width is None and not by:
        width = _width(both)
    if width is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    else:
        both = both.withColumn("__p", piece(width, F.col("__at")))
        nearest = (F.max_by if direction == "backward" else F.min_by)("__r", F.when(F.col("__side") == 0, F.col("__at")))
        ends = both.groupBy(*keys, "__p").agg(nearest.alias("__e"))
        way = F.col("__p").asc() if direction == "backward" else F.col("__p").desc()
        before = Window.partitionBy(*keys).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, "__p", F.last("__e", ignorenulls=True).over(before).alias("__e"))
        w = Window.partitionBy(*keys, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("__own", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1").join(ends, [*keys, "__p"])
        both = both.withColumn("__m", F.coalesce("__own", "__e"))
    gap = F.abs(F.unix_micros("__at") - F.unix_micros(F.col("__m.__clock")))
    found = F.col("__m") if limit is None else F.when(gap <= limit, F.col("__m"))
    matched = both.select("__l", found.alias("__m"))
    alone = base.filter(~F.col("__ok")).select("__l", F.lit(None).cast(r.schema["__r"].dataType).alias("__m"))
    return matched.unionByName(alone).select(
        *(F.col(f"__l.l{i}").alias(c) for i, c in enumerate(left.columns)),
        F.col("__m.matched_t").alias(match_name), *(F.col(f"__m.r{i}").alias(names[c]) for i, c in enumerate(taken)),
    )


@dataclass(frozen=True)
class Clock:
    """When the rows of a right side became known.

    column: a column with the knowledge time; span: a column or timeframe of the period a row covers (bars, buckets),
    known at its end plus lag_seconds; fetched_at: all rows known at one instant; shown False: the table doesn't show it.
    """

    column: str | None = None
    span: str | None = None
    lag_seconds: int = 0
    fetched_at: str | None = None
    shown: bool = True

    def known(self, df: DataFrame, time: str) -> Column:
        t = F.col(time).cast("timestamp")
        if self.fetched_at is not None:
            return F.lit(self.fetched_at).cast("timestamp")
        if self.column is not None:
            return F.when(F.col(self.column).isNotNull(), F.greatest(t, F.col(self.column).cast("timestamp")))
        if self.span is not None:
            t = span_end(t, F.col(self.span) if self.span in df.columns else F.lit(self.span))
        return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(self.lag_seconds)).cast("decimal(18,6)"))


@dataclass
class Alignment:
    """An aligned table with what a reader should know of it; the counts run only when asked for."""

    df: DataFrame
    right: DataFrame
    match_on: str
    point_in_time: bool
    versions: DataFrame | None = None  #: the right side's rows with __t and __known, before the newest of each were picked
    by: tuple[tuple[str, str], ...] = ()
    left_time: str = ""

    def unmatched(self) -> int:
        return self.df.filter("matched_t IS NULL").count()

    def stale(self) -> DataFrame:
        """The rows whose match isn't the newest that the right side dates at or before them: a newer one (`newest_t`) is there,
        but wasn't known yet. A second as-of join, on the right side's own times."""
        if self.versions is None:
            raise Refusal("not_point_in_time", "The table wasn't matched on when rows became known.")
        keys = [b for _, b in self.by]
        times = self.versions.select(*keys, F.col("__t").alias("__newest")).distinct()
        out = asof_join(self.df, times, self.left_time, "__newest", list(self.by), right_columns=[], suffix="_newest", match_name="newest_t")
        return out.filter(F.col("newest_t") > F.col("matched_t"))

    def revised(self) -> tuple[int, int]:
        """Of a right side with one version of each time: how many rows became known after a later time's row did (they are
        shown as revised), and how many there are. (0, 0) where it has several versions."""
        if self.versions is None:
            return 0, 0
        keys = [b for _, b in self.by]
        one = self.versions.groupBy(*keys, "__t").agg(F.max("__known").alias("k"), F.count("*").alias("n"))
        later = Window.partitionBy(*keys).orderBy(F.col("__t").desc()).rowsBetween(Window.unboundedPreceding, -1)
        row = one.withColumn("next", F.min("k").over(later)).agg(
            F.max("n").alias("n"), F.count("*").alias("total"), F.count(F.when(F.col("k") > F.col("next"), 1)).alias("revised")
        ).first()
        return (row.revised, row.total) if row.n == 1 else (0, 0)

    def look_ahead(self, left_time: str) -> int:
        """Matches that weren't known yet at the left row's time (only with match_on time)."""
        return self.df.filter(F.col("__known") > F.col(left_time)).count() if "__known" in self.df.columns else 0


def align(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[tuple[str, str]] = (), direction: str = "backward",
    tolerance: str | None = None, right_columns: list[str] | None = None, suffix: str = "_right", match_on: str = "available",
    clock: Clock | None = None, series: str | None = None,
) -> Alignment:
    """As-of join on the time at which right rows became known (match_on available) or on their own time.

    A clock that isn't shown is refused unless match_on is time. Rows that were never known (null clock) are left
    out. `series` names the right side's series column: several series without `by` are refused.
    """
    if match_on not in ("available", "time"):
        raise Refusal("invalid_arguments", "match_on is available or time.")
    if not by and series is not None and right.select(series).distinct().limit(2).count() > 1:
        raise Refusal("right_not_single_series", "The right side has several series.", "Pass by.")
    if clock is not None and not clock.shown and match_on == "available":
        raise Refusal("not_point_in_time", "The right side doesn't show when its rows became known.", "Use match_on=time.")
    if right_columns is None:
        right_columns = [c for c in right.columns if c not in (right_time, "absent", *(b for _, b in by))]
    if clock is None:
        out = asof_join(left, right, left_time, right_time, by, direction, tolerance, right_columns, suffix)
        return Alignment(out, right, match_on, False)
    known = right.withColumn("__known", clock.known(right, right_time))
    if match_on == "time":
        out = asof_join(left, known, left_time, right_time, by, direction, tolerance, [*right_columns, "__known"], suffix)
        return Alignment(out, known, match_on, False)
    known = known.filter("__known IS NOT NULL").withColumn("__t", F.col(right_time).cast("timestamp"))
    versions, known = known, dominant(known, [b for _, b in by], "__t", "__known")
    out = asof_join(left, known, left_time, right_time, by, direction, tolerance, right_columns, suffix, match="__known")
    return Alignment(out, known, match_on, direction == "backward", versions, tuple(by), left_time)
