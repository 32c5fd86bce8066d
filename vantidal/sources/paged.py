"""Paged sources: requests until there is no next page, a row cap or a page cap; a token bucket paces them.

`PagedSource` is a Python data source: the keys are dealt to partitions, and each task pages through its
own keys. The fetch function is the caller's, so nothing here knows a vendor.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Rows and pages of a fetch at most.
MOST_ROWS, MOST_PAGES = 50_000, 20


@dataclass
class Page:
    rows: list
    next: str | None = None


@dataclass
class Fetched:
    rows: list
    pages: int
    truncated: bool


def paginate(fetch: Callable[[str | None], Page], most_rows: int = MOST_ROWS, most_pages: int = MOST_PAGES) -> Fetched:
    """All pages, or as many as the caps allow; a token that repeats ends the loop."""
    rows: list = []
    token, seen = None, set()
    for n in range(1, most_pages + 1):
        page = fetch(token)
        rows += page.rows
        token = page.next
        if len(rows) > most_rows:
            return Fetched(rows[:most_rows], n, True)
        if not token or token in seen:
            return Fetched(rows, n, False)
        seen.add(token)
    return Fetched(rows, most_pages, True)


class TokenBucket:
    """So many requests a minute, with bursts up to the bucket's size; callers wait their turn."""

    def __init__(self, per_minute: float, size: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.size = per_minute / 60, size if size is not None else max(1.0, per_minute / 60)
        self.level, self.clock, self.sleep, self.lock = self.size, clock, sleep, threading.Lock()
        self.at = clock()

    def take(self, n: float = 1) -> float:
        """Waits until n requests may go; returns the seconds waited."""
        with self.lock:
            now = self.clock()
            self.level = min(self.size, self.level + (now - self.at) * self.rate)
            self.at = now
            self.level -= n
            wait = max(0.0, -self.level / self.rate)
        if wait:
            self.sleep(wait)
        return wait


def fetch_keys(spark: SparkSession, keys: list[str], fetch: Callable[[str, str | None], Page], schema: str, per_minute: float = 190, tasks: int = 8) -> DataFrame:
    """Rows of all keys, with `truncated`: whether a cap cut the key's rows. The rate is divided among the tasks, so the
    whole stays within it."""
    tasks = max(1, min(tasks, len(keys)))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        bucket = TokenBucket(per_minute / tasks)
        for pdf in batches:
            for key in pdf["key"]:

                def one(token: str | None, key: str = key) -> Page:
                    bucket.take()
                    return fetch(key, token)

                got = paginate(one)
                if got.rows:
                    yield pd.DataFrame(got.rows).assign(truncated=got.truncated)

    frame = spark.createDataFrame([(k,) for k in keys], "key string").repartition(tasks, "key")
    return frame.mapInPandas(run, f"{schema}, truncated boolean")
