"""Operators of users' own: registered by name with a schema, switched by capability."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vantidal.errors import Refusal


@dataclass(frozen=True)
class Operator:
    """`run` takes frames and keyword arguments and returns a frame of `schema` (None: whatever it has)."""

    name: str
    run: Callable[..., DataFrame]
    schema: T.StructType | None = None
    capability: str = "analytics"
    read_only: bool = True
    summary: str = ""


@dataclass
class Registry:
    """Operators by name. A plugin registers all of its operators or none."""

    operators: dict[str, Operator] = field(default_factory=dict)
    off: set[str] = field(default_factory=set)  #: capabilities that are switched off

    def register(self, plugin: Iterable[Operator]) -> None:
        staged = list(plugin)
        names = [o.name for o in staged]
        twice = {n for n in names if names.count(n) > 1 or n in self.operators}
        if twice:
            raise Refusal("invalid_arguments", f"There is already an operator {sorted(twice)[0]}.")
        for o in staged:
            if not o.name.isidentifier() or not o.read_only:
                raise Refusal("invalid_arguments", f"{o.name} needs a plain name and to be read-only.")
        self.operators |= {o.name: o for o in staged}

    def available(self) -> list[str]:
        return sorted(n for n, o in self.operators.items() if o.capability not in self.off)

    def call(self, name: str, *frames: DataFrame, **arguments) -> DataFrame:
        if name not in self.available():
            raise Refusal("invalid_arguments", f"There is no operator {name}.", f"There are {', '.join(self.available())}.")
        o = self.operators[name]
        out = o.run(*frames, **arguments)
        if o.schema is not None:
            want = [(f.name, f.dataType) for f in o.schema]
            if [(f.name, f.dataType) for f in out.schema] != want:
                raise Refusal("internal_error", f"{name} returned other columns than it declares.")
        return out
