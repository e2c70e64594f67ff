"""The engine: typed requests over a table of organism events, answered by DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formicary.operators import counts, graph, markov, sketches, store, windows


class UnknownRequest(ValueError):
    """A request type that isn't defined."""


class Engine:
    """Answers requests by name and parameters. Answers are lazy and have no size limit.

    events: flat organism events with an order of arrival (`seq`, by default `id`). now: what recency is
    measured from, by default the latest event time.
    """

    def __init__(self, events: DataFrame, now: datetime | None = None, seq: str = "id") -> None:
        self.events, self.seq = events, seq
        self.now = now or store.as_of(events)
        self.requests: dict[str, Callable[..., DataFrame]] = {
            "stats": self.stats, "species": self.species, "habitat_event": self.habitat_event, "bloom_filter": self.bloom_filter, "minwise": self.minwise, "cantidad": self.distinct_species,
            "hyperloglog": self.hyperloglog, "dgim_filter": self.dgim_filter, "random_walk": self.random_walk, "eco_density": self.eco_density, "pagerank": self.score, "mapreduce": self.mapreduce, "markov": self.markov,
        }

    def run(self, kind: str, **params: Any) -> DataFrame:
        if kind not in self.requests:
            raise UnknownRequest(f"unknown request {kind!r}; there are {', '.join(sorted(self.requests))}")
        return self.requests[kind](**params)

    def _window(self, window: str | float, known: dict[str, int]) -> DataFrame:
        seconds = windows.window_seconds(window, known) if isinstance(window, str) else window
        return store.recent(self.events, seconds, self.now)

    def stats(self) -> DataFrame:
        return store.stats(self.events)

    def species(self, species: str, limit: int | None = 10) -> DataFrame:
        return store.by_species(self.events, species, limit, self.seq)

    def habitat_event(self, habitat: str, event: str, limit: int | None = 10) -> DataFrame:
        return store.by_habitat_event(self.events, habitat, event, limit, self.seq)

    def eco_density(self, limit: int | None = 10) -> DataFrame:
        return store.impact_and_density(self.events, limit, self.seq)

    def distinct_species(self, window: str | float = "5min") -> DataFrame:
        return windows.distinct_species(self._window(window, windows.LIST_WINDOWS))

    def bloom_filter(self, species: str, role: str, event: str, window: str | float = "5min", p: float = 0.03) -> DataFrame:
        """(key, maybe) for one combination against the window's."""
        keys = self._window(window, windows.LIST_WINDOWS).select(sketches.key_of("species", "role", "event").alias("key")).distinct()
        bits, hashes = sketches.bloom_size(keys.count(), p)
        asked = self.events.sparkSession.range(1).select(F.lit(f"{species}_{role}_{event}").alias("key"))
        return sketches.bloom_probe(asked, "key", sketches.bloom_build(keys, "key", bits, hashes), bits, hashes)

    def minwise(self, species: str, role: str, age: int = 0, window: str | float = "5min", mode: str = "default") -> DataFrame:
        """(key, similarity, label); mode reference: the window's ages all count as 0."""
        rows = self._window(window, windows.LIST_WINDOWS)
        rows = rows.withColumn("age", F.lit(0)) if mode == "reference" else rows
        keyed = rows.select(sketches.key_of("species", "role", "age").alias("key"))
        asked = self.events.sparkSession.range(1).select(F.lit(f"{species}_{role}_{0 if mode == 'reference' else age}").alias("key"))
        return sketches.redundancy(keyed, asked, "key")

    def hyperloglog(self, column: str = "species", window: str | float = "5min") -> DataFrame:
        return sketches.hll_estimate(sketches.hll_registers(self._window(window, windows.LIST_WINDOWS), F.col(column)))

    def dgim_filter(self, window: str | float = "5min", event: str = "predator attack", mode: str = "default", width: int = 300) -> DataFrame:
        rows = self._window(window, windows.LIST_WINDOWS).withColumn("bit", sketches.bit_of(event))
        if mode == "reference":
            return sketches.dgim_replay(rows, "bit", width, order=self.seq)
        return sketches.dgim_estimate(rows, "bit", width, self.now, order=self.seq)

    def random_walk(self, start: str, steps: int = 5, walks: int = 1, window_seconds: float = 300, threshold_km: float = graph.THRESHOLD_KM) -> DataFrame:
        places = graph.vertices(store.recent(self.events, window_seconds, self.now), self.seq)
        return graph.walk_from(places, graph.edges(places, threshold_km), start, walks, steps)

    def score(self, limit: int | None = None) -> DataFrame:
        return counts.species_score(self.events, limit, self.seq)

    def mapreduce(self, maps: int = 4, reduces: int = 2) -> DataFrame:
        return counts.map_reduce(self.events, maps, reduces)

    def markov(self, what: str = "chain", mode: str = "standard") -> DataFrame:
        """what: chain, matrix or classes."""
        chain = markov.transitions(self.events)
        if what == "chain":
            return chain
        if what == "matrix":
            return markov.matrix(self.events, chain)
        if what == "classes":
            return markov.classify(chain, mode=mode)
        raise ValueError(f"what must be chain, matrix or classes: {what}")
