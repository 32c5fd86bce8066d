"""When the rows of derived tables became known: rules that follow a table through queries and analytics."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantidal.functions.timeframes import span_end, time_bucket
from vantidal.operators.asof import Clock
from vantidal.plans.lineage import Lineage, lineage
from vantidal.schema.models import Model


@dataclass(frozen=True)
class RowsOf:
    """What a table's rows are made of, and by what rule they became known.

    span: a timeframe (or column) that a row covers, known at its end plus lag_seconds; fetched: known when they were
    fetched; clock: a column with the time; shown False: the table doesn't show when.
    """

    model: str | None = None
    fetched_at: datetime | None = None
    fetched: bool = False
    span: str | None = None
    lag_seconds: int = 0
    clock: str | None = None
    adjustment: str | None = None
    shown: bool = True

    def as_clock(self) -> Clock:
        return Clock(self.clock, self.span, self.lag_seconds, self.fetched_at.isoformat() if self.fetched and self.fetched_at else None, self.shown)

    @property
    def late(self) -> bool:
        """Rows are known only after their time."""
        return bool(self.span or self.lag_seconds or self.fetched)


def of_model(model: Model, fetched_at: datetime | None = None, adjustment: str | None = None) -> RowsOf:
    return RowsOf(model.name, fetched_at, model.known_at_fetch, model.span, 0, model.available, adjustment)


@dataclass
class Known:
    """A table, its time column and rule."""

    df: DataFrame
    time: str
    rule: RowsOf | None


def bucketed(inputs: list[Known], period: str) -> RowsOf | None:
    """The rule of rows dated at bucket starts: known at the bucket's end, or as much later as any row in it is.

    One aggregate over each input. None where no input has a rule.
    """
    rules = [k.rule for k in inputs if k.rule is not None]
    if not rules:
        return RowsOf(span=period) if inputs else None
    if any(not r.shown for r in rules) or len({r.fetched for r in rules}) > 1:
        return _hidden(rules)
    if rules[0].fetched:
        return replace(rules[0], fetched_at=max(r.fetched_at for r in rules if r.fetched_at))
    lag = 0
    for k in inputs:
        t = F.col(k.time).cast("timestamp")
        known = k.rule.as_clock().known(k.df, k.time) if k.rule else t
        end = span_end(time_bucket(period, t), F.lit(period))
        gap = k.df.filter(t.isNotNull()).agg(F.max(F.unix_micros(known) - F.unix_micros(end))).first()[0]
        if gap is not None and gap > 0:
            lag = max(lag, math.ceil(gap / 1_000_000))
    return RowsOf(rules[0].model, _newest(rules), False, period, lag, None, _adjusted(rules))


def dated_as(inputs: list[Known], keeps_clock: bool = False, levels: bool = True) -> RowsOf | None:
    """The rule of rows dated as input rows (returns, windows, drawdowns that end there)."""
    rules = [k.rule for k in inputs if k.rule is not None]
    if not rules:
        return None
    if len(rules) < len(inputs) and any(r.late for r in rules):
        return _hidden(rules)
    if any(r.clock for r in rules) and not keeps_clock:
        return _hidden(rules)
    if any(not r.shown for r in rules) or len({(r.fetched, r.span) for r in rules}) > 1:
        return _hidden(rules)
    return replace(rules[0], fetched_at=_newest(rules), lag_seconds=max(r.lag_seconds for r in rules), adjustment=_adjusted(rules) if levels else None)


def of_query(out: DataFrame, inputs: dict[str, Known]) -> tuple[RowsOf | None, Lineage]:
    """The rule of a query's rows, as far as its plan proves it.

    Rows of one input that pass through keep its rule if its time (and span or clock) columns are there. Joined
    inputs keep a rule if their times are equal and the rules agree. Rows that may hold what others say don't show
    when they became known.
    """
    found = lineage(out)
    used = [inputs[r] for r in found.relations if r in inputs]
    rules = [k.rule for k in used if k.rule is not None]
    if not rules:
        return None, found
    if found.from_others or found.grouped or len(used) < len(found.relations):
        return _hidden(rules), found
    held = {s for sources in found.columns.values() for s in sources}
    times = [(r, inputs[r].time) for r in found.relations if r in inputs]
    for (r, t) in times:
        rule = inputs[r].rule
        need = [t] + [c for c in ((rule.span, rule.clock) if rule else ()) if c and c in inputs[r].df.columns]
        if any(not any(found.same((r, c), h) for h in held) for c in need):
            return _hidden(rules), found
    if any(not found.same(times[0], t) for t in times[1:]):
        return _hidden(rules), found
    if any(not r.shown for r in rules) or len({(r.span, r.fetched, r.lag_seconds) for r in rules}) > 1 or len(rules) < len(used):
        return _hidden(rules), found
    return replace(rules[0], fetched_at=_newest(rules)), found


def inherited(out: DataFrame, inputs: dict[str, Known]) -> DataFrame:
    """The query's rows with the units and roles of the columns that pass through unchanged from a single source."""
    found = lineage(out)
    cols = []
    for f in out.schema:
        sources = found.columns.get(f.name, frozenset())
        meta = dict(f.metadata or {})
        if len(sources) == 1:
            ((r, c),) = sources
            if r in inputs and c in inputs[r].df.columns:
                meta = dict(inputs[r].df.schema[c].metadata or {})
                if found.from_others or found.grouped:
                    meta.pop("role", None)
        cols.append(F.col(f"`{f.name}`").alias(f.name, metadata=meta))
    return out.select(*cols)


BAR_COLUMNS = ("open", "high", "low", "close", "volume")
BAR_MODELS = ("Bar", "OptionBar")


def passes_bars(df: DataFrame, rule: RowsOf | None) -> bool:
    """Whether rows are bars that a query handed on: made of bars, with all five bar columns as numbers."""
    from vantidal.operators.points import NUMERIC

    kinds = {f.name: f.dataType for f in df.schema}
    return rule is not None and rule.model in BAR_MODELS and rule.shown and all(isinstance(kinds.get(c), NUMERIC) for c in BAR_COLUMNS)


def lost_clocks(out: DataFrame, inputs: dict[str, Known]) -> list[str]:
    """Which columns of when a row became known a query's answer leaves out, changes or computes, and so can't be matched on."""
    found = lineage(out)
    kinds = {f.name: f.dataType for f in out.schema}
    notes = []
    for rid in found.relations:
        if rid not in inputs:
            continue
        for f in inputs[rid].df.schema:
            if (f.metadata or {}).get("role") != "available":
                continue
            if kinds.get(f.name) != f.dataType:
                notes.append(f"{f.name} of {rid} is left out: keep it, with its name and type, to match point in time.")
            elif not any((rid, f.name) == s or found.same((rid, f.name), s) for s in found.columns.get(f.name, ())):
                notes.append(f"{f.name} is computed, so it doesn't show when the rows of {rid} became known.")
            elif found.from_others or found.grouped:
                notes.append(f"{f.name} of {rid} stands beside rows made from others ({', '.join(found.notes) or 'groups'}), so it may be earlier than what they say.")
    return notes


def _newest(rules: list[RowsOf]) -> datetime | None:
    return max((r.fetched_at for r in rules if r.fetched_at), default=None)


def _adjusted(rules: list[RowsOf]) -> str | None:
    return next((r.adjustment for r in rules if r.adjustment not in (None, "raw")), rules[0].adjustment)


def _hidden(rules: list[RowsOf]) -> RowsOf:
    first = next((r for r in rules if r.late), rules[0])
    return RowsOf(first.model, _newest(rules), adjustment=_adjusted(rules), shown=False)
