"""When a dataset's slice is fetched anew: a slice that was synchronised within its time to live is read as it is."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from vantidal.errors import Refusal
from vantidal.session import _file_system

#: auto: fetch what is too old; local: never fetch; always: fetch anyhow.
MODES = ("auto", "local", "always")


@dataclass
class Slice:
    """A part of a dataset that is fetched at once, below a folder: a Parquet table for each fetch, and when it was."""

    spark: SparkSession
    root: str
    name: str

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name}"

    def synced(self) -> datetime | None:
        fs, p = _file_system(self.spark, f"{self.path}/synced.json")
        if not fs.exists(p):
            return None
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/synced.json").collect())  # one short line
        return datetime.fromisoformat(json.loads(text)["at"])

    def mark(self, at: datetime) -> None:
        fs, p = _file_system(self.spark, f"{self.path}/synced.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"at": at.isoformat()}).encode()))
        out.close()


def refresh(part: Slice, fetch: Callable[[], DataFrame], ttl: timedelta, mode: str = "auto", now: datetime | None = None) -> tuple[DataFrame, bool]:
    """The slice's rows, and whether they were fetched now. Every fetch is kept, so earlier versions stay readable."""
    if mode not in MODES:
        raise Refusal("invalid_arguments", f"'{mode}' is none of {', '.join(MODES)}.")
    now = now or datetime.now(UTC)
    last = part.synced()
    due = mode == "always" or (mode == "auto" and (last is None or now - last > ttl))
    if due:
        fetch().write.mode("append").parquet(f"{part.path}/versions")
        part.mark(now)
    elif last is None:
        raise Refusal("no_data", f"{part.name} was never fetched.", "Use mode auto.")
    return part.spark.read.parquet(f"{part.path}/versions"), due
