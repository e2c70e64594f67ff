"""The keyed store: upsert, lookups, statistics and retention over flat organism events.

`id` order stands for the order of arrival unless another column is named.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(events: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last row of each key by `seq`: one aggregation with partial results, no window."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_last")).select(key, "_last.*")


def _limited(rows: DataFrame, limit: int | None, order: str) -> DataFrame:
    if limit is not None and limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    return rows.orderBy(order).limit(limit) if limit else rows


def by_species(events: DataFrame, species: str, limit: int | None = 10, order: str = "id") -> DataFrame:
    """Events of a species in order of arrival; 0 or None: all of them."""
    return _limited(events.filter(F.col("species") == species), limit, order)


def by_habitat_event(events: DataFrame, habitat: str, event: str, limit: int | None = 10, order: str = "id") -> DataFrame:
    """Events of a kind in a habitat, in order of arrival."""
    return _limited(events.filter((F.col("habitat") == habitat) & (F.col("event") == event)), limit, order)


def impact_and_density(events: DataFrame, limit: int | None = 10, order: str = "id") -> DataFrame:
    """id, ecological_impact, population_density, species and ts, in order of arrival."""
    columns = list(dict.fromkeys(["id", "ecological_impact", "population_density", "species", "ts", order]))
    return _limited(events.select(*columns), limit, order).select(*columns[:5])


def as_of(events: DataFrame, ts: str = "ts") -> datetime | None:
    """The latest event time, what recency is measured from where no clock is given."""
    return events.agg(F.max(ts)).first()[0]


def age_seconds(now: Column, ts: str = "ts") -> Column:
    """Seconds from the event to `now`; negative for events in the future."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return micros / 1_000_000


def recent(events: DataFrame, seconds: float, now: datetime, ts: str = "ts") -> DataFrame:
    """Events at most so old, bound included; future events are recent."""
    return events.filter(age_seconds(F.lit(now), ts) <= seconds)


def stats(events: DataFrame) -> DataFrame:
    """(dimension, value, n): the total and the counts by species, role, habitat and event, in one pass."""
    dims = ["species", "role", "habitat", "event"]
    pairs = F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims))
    combined = events.groupBy(*dims).agg(F.count("*").alias("_n"))
    return combined.select(F.explode(pairs).alias("p"), "_n").groupBy("p.dimension", "p.value").agg(F.sum("_n").alias("n"))


def stats_with_history(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stats of the stored rows that show 0 for values that only rows since removed had."""
    return stats(seen).select("dimension", "value").join(stats(stored), ["dimension", "value"], "left").select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"))


def retain(events: DataFrame, hours: float, now: datetime, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): events older than `hours` are removed, those exactly so old are kept."""
    old = age_seconds(F.lit(now), ts) > hours * 3600
    return events.filter(~old), events.filter(old)
