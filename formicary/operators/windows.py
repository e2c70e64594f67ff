"""Window tables over events: how many, which, and in what lists.

Two meanings of "the last N": by event time against a moment (`as_of`), the default, and the counters
that count an event once, at its arrival, if it was then at most N old ("at arrival").
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formicary.operators.store import age_seconds

MINUTE = 60
#: fixed values: windows of the counters and of the lists, in seconds
COUNTER_WINDOWS = {"1min": 60, "5min": 300, "15min": 900, "1hour": 3600}
LIST_WINDOWS = {"1min": 60, "2min": 120, "5min": 300}


class UnknownWindow(ValueError):
    """A window name that isn't defined."""


def window_seconds(name: str, windows: dict[str, int]) -> int:
    if name not in windows:
        raise UnknownWindow(f"unknown window {name!r}; there are {', '.join(windows)}")
    return windows[name]


def _in_windows(events: DataFrame, windows: dict[str, float], age: Column) -> DataFrame:
    """A row for each window that an event is in. Ages are compared once; the windows are few."""
    names = F.array(*(F.when(F.col("_age") <= s, F.lit(n)) for n, s in windows.items()))
    aged = events.withColumn("_age", age)
    return aged.withColumn("window", F.explode(F.filter(names, lambda x: x.isNotNull()))).drop("_age")


def as_of_windows(events: DataFrame, windows: dict[str, float], now: datetime, ts: str = "ts") -> DataFrame:
    """Events with the windows that hold them at the moment `now` (bounds included)."""
    return _in_windows(events, windows, age_seconds(F.lit(now), ts))


def arrival_windows(events: DataFrame, windows: dict[str, float], arrival: str = "arrival", ts: str = "ts", drop_after: float | None = 3600) -> DataFrame:
    """Events with the windows that counted them when they arrived.

    Events more than drop_after seconds late are in no window (they may still be stored).
    """
    age = age_seconds(F.col(arrival), ts)
    on_time = events.filter(~(age > drop_after)) if drop_after is not None else events
    return _in_windows(on_time, windows, age)


def group_counts(windowed: DataFrame) -> DataFrame:
    """(window, species, role, n)."""
    return windowed.groupBy("window", "species", "role").agg(F.count("*").alias("n"))


def event_trends(windowed: DataFrame) -> DataFrame:
    """(window, event, species, n)."""
    return windowed.groupBy("window", "event", "species").agg(F.count("*").alias("n"))


def species_trends(windowed: DataFrame) -> DataFrame:
    """(window, species, n)."""
    return windowed.groupBy("window", "species").agg(F.count("*").alias("n"))


def window_totals(counts: DataFrame) -> DataFrame:
    """(window, n): the sum of a window's group counts."""
    return counts.groupBy("window").agg(F.sum("n").alias("n"))


def distinct_species(events: DataFrame) -> DataFrame:
    return events.select("species").distinct()


def event_lists(events: DataFrame, length: str, by: str = "ts", order: str = "id") -> DataFrame:
    """(window_start, species, role, events): lists in order of arrival, cut into tumbling windows of `by`.

    A list holds one window's events of one group, so its size follows the window and not the history.
    """
    cut = events.withColumn("window_start", F.window(by, length).start)
    lists = cut.groupBy("window_start", "species", "role").agg(F.collect_list(F.struct(order, "event")).alias("_l"))
    return lists.select("window_start", "species", "role", F.transform(F.array_sort("_l"), lambda x: x["event"]).alias("events"))
