"""Markov chains over event types: transitions, matrix, and the classes of states.

Transitions are counted on the executors, by ranges of time that are stitched at their bounds. The
matrix has a row for each pair of states, so it is the distinct states that bound its size. The classes
are worked out on the driver for chains of up to DRIVER_EDGES edges, by joins for larger ones.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formicary.functions.ordering import quantile_bounds, range_number, with_next
from formicary.functions.scratch import Scratch

#: Edges of a chain whose classes are worked out on the driver (some 100 MB there).
DRIVER_EDGES = 500_000

_CLASS = "state string, component long, recurrent boolean, period int, aperiodic boolean, ergodic boolean"


def transitions(events: DataFrame, ts: str = "ts", event: str = "event") -> DataFrame:
    """(from, to, n, p) of consecutive events by (time, event); rows without a time or event are skipped.

    p is the share among the transitions from a state. Fewer than two events give no rows.
    """
    rows = events.select(ts, event).filter(F.col(ts).isNotNull() & F.col(event).isNotNull())
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    paired = with_next(rows, [ts, event], event, range_number(micros, quantile_bounds(rows, micros)))
    counts = paired.filter("next is not null").groupBy(F.col(event).alias("from"), F.col("next").alias("to")).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def keyed_transitions(events: DataFrame, keys: list[str], ts: str = "ts", event: str = "event") -> DataFrame:
    """(keys..., from, to, n, p): a chain for each key; a key with many rows is paired up by ranges of time."""
    rows = events.select(*keys, ts, event).filter(F.col(ts).isNotNull() & F.col(event).isNotNull())
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    paired = with_next(rows, [ts, event], event, range_number(micros, quantile_bounds(rows, micros)), keys=keys)
    counts = paired.filter("next is not null").groupBy(*keys, F.col(event).alias("from"), F.col("next").alias("to")).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "from")))


def matrix(events: DataFrame, chain: DataFrame, event: str = "event") -> DataFrame:
    """(from, to, p) for every pair of states; a state that is only seen last has a row of zeros."""
    states = chain.select(F.col("from").alias("s")).union(chain.select("to")).distinct()
    every = F.broadcast(states.agg(F.array_sort(F.collect_set("s")).alias("_to")))  # the states, once
    grid = states.select(F.col("s").alias("from")).join(every).select("from", F.explode("_to").alias("to"))
    return grid.join(chain.select("from", "to", "p"), ["from", "to"], "left").select("from", "to", F.coalesce("p", F.lit(0.0)).alias("p"))


@dataclass
class StateClass:
    state: str
    component: int
    recurrent: bool
    period: int
    ergodic: bool


class Chain:
    """A small directed graph of states in name order, with the edges of positive probability."""

    def __init__(self, edges: list[tuple[str, str]], states: list[str] | None = None) -> None:
        self.states = sorted({*(states or []), *(s for e in edges for s in e)})
        number = {s: k for k, s in enumerate(self.states)}
        out: list[set[int]] = [set() for _ in number]
        for a, b in edges:
            out[number[a]].add(number[b])
        self.next = [sorted(x) for x in out]

    def components(self) -> list[list[int]]:
        """Strongly connected components; each lists its latest visited state first.

        Depth first from the least state, along rising neighbours, without recursion.
        """
        order: dict[int, int] = {}
        low: dict[int, int] = {}
        open_: list[int] = []
        waiting: set[int] = set()
        out = []
        for root in range(len(self.states)):
            if root in order:
                continue
            work = [(root, iter(self.next[root]))]
            order[root] = low[root] = len(order)
            open_.append(root)
            waiting.add(root)
            while work:
                at, rest = work[-1]
                to = next(rest, None)
                if to is not None:
                    if to not in order:
                        order[to] = low[to] = len(order)
                        open_.append(to)
                        waiting.add(to)
                        work.append((to, iter(self.next[to])))
                    elif to in waiting:
                        low[at] = min(low[at], order[to])
                    continue
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == order[at]:
                    cut = open_.index(at)
                    out.append(open_[cut:][::-1])
                    waiting.difference_update(open_[cut:])
                    del open_[cut:]
        return out

    def _levels(self, start: int, within: set[int] | None = None) -> dict[int, int]:
        level, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for to in self.next[at]:
                if to not in level and (within is None or to in within):
                    level[to] = level[at] + 1
                    queue.append(to)
        return level

    def shortest_return_period(self, start: int) -> int:
        """gcd of the lengths of returns along shortest paths; 1 if there is none."""
        level = self._levels(start)
        out = 0
        for at, n in level.items():
            if start in self.next[at]:
                out = gcd(out, n + 1)
        return out or 1

    def true_period(self, component: list[int]) -> int:
        """gcd of all cycle lengths of a component; 1 if it has no cycle."""
        inside = set(component)
        level = self._levels(component[0], inside)
        out = 0
        for at in component:
            for to in self.next[at]:
                if to in inside:
                    out = gcd(out, level[at] + 1 - level[to])
        return abs(out) or 1

    def classify(self, mode: str = "standard") -> list[StateClass]:
        """Classes of all states in name order.

        standard: recurrent states are those of closed components, periods are true ones. reference:
        recurrent means on a cycle, the period is that of shortest returns to the component's first state.
        """
        if mode not in ("standard", "reference"):
            raise ValueError(f"mode must be standard or reference: {mode}")
        out = []
        for k, component in enumerate(self.components()):
            inside = set(component)
            cycle = len(component) > 1 or component[0] in self.next[component[0]]
            closed = all(to in inside for at in component for to in self.next[at])
            if mode == "reference":
                recurrent, period = cycle, self.shortest_return_period(component[0])
            else:
                recurrent, period = cycle and closed, self.true_period(component)
            out += [StateClass(self.states[at], k, recurrent, period, recurrent and period == 1) for at in component]
        return sorted(out, key=lambda x: x.state)


def classify(chain: DataFrame, least_p: float = 0.0, mode: str = "standard", driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(state, component, recurrent, period, aperiodic, ergodic) of the chain's edges with p > least_p.

    Rows with a null state are skipped. Chains of more than driver_edges edges are worked out by joins, with equal results but for the
    numbers of components (any; equal within one). mode reference is for the others alone: its periods hang on
    the order of a depth-first walk, which doesn't come in parts.
    """
    spark = chain.sparkSession
    if mode not in ("standard", "reference"):
        raise ValueError(f"mode must be standard or reference: {mode}")
    rows = chain.filter("from is not null and to is not null").groupBy("from", "to").agg(F.coalesce(F.max(F.col("p") > least_p), F.lit(False)).alias("kept"))
    some = rows.limit(driver_edges + 1).toArrow()  # a bounded number of rows, in one job
    if some.num_rows <= driver_edges:
        pairs = list(zip(some["from"].to_pylist(), some["to"].to_pylist(), some["kept"].to_pylist(), strict=True))
        found = Chain([(a, b) for a, b, kept in pairs if kept], [s for a, b, _ in pairs for s in (a, b)]).classify(mode)
        return spark.createDataFrame([(x.state, x.component, x.recurrent, x.period, x.period == 1, x.ergodic) for x in found], _CLASS)
    if mode == "reference":
        raise ValueError(f"more than {driver_edges} edges; the reference mode takes chains of fewer")
    scratch = Scratch(spark)
    pairs = scratch.keep(rows)
    states = pairs.select(F.col("from").alias("s")).union(pairs.select("to")).distinct()
    return _classify_by_joins(states, pairs.filter("kept").select("from", "to"), scratch)


def _classify_by_joins(states: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """`classify` in its standard mode, of (s) and distinct (from, to), without edges on the driver."""
    named = scratch.keep(states.select(F.col("s").alias("state"), F.monotonically_increasing_id().alias("v")))
    number = lambda side, name: named.select(F.col("state").alias(side), F.col("v").alias(name))
    links = scratch.keep(edges.join(number("from", "a"), "from").join(number("to", "b"), "to").select("a", "b"))
    members, levels = strong_components(links, scratch)
    whole = scratch.keep(named.join(members, "v", "left").join(levels, "v", "left").select("state", "v", F.coalesce("c", "v").alias("c"), F.coalesce("level", F.lit(0)).alias("level")))
    ends = lambda side, c, level: whole.select(F.col("v").alias(side), F.col("c").alias(c), F.col("level").alias(level))
    placed = scratch.keep(links.join(ends("a", "c", "_from"), "a").join(ends("b", "_c", "_to"), "b").select("c", (F.col("c") == F.col("_c")).alias("inside"), F.abs(F.col("_to") + 1 - F.col("_from")).alias("g")))
    open_ = placed.filter("not inside").select("c").distinct().withColumn("_open", F.lit(True))
    periods = _greatest_divisors(placed.filter("inside").select("c", "g"))
    out = whole.join(open_, "c", "left").join(periods, "c", "left")
    recurrent, period = F.col("g").isNotNull() & F.col("_open").isNull(), F.greatest(F.coalesce("g", F.lit(1)), F.lit(1)).cast("int")
    return out.select("state", F.col("c").alias("component"), recurrent.alias("recurrent"), period.alias("period"), (period == 1).alias("aperiodic"), (recurrent & (period == 1)).alias("ergodic"))


def _greatest_divisors(rows: DataFrame) -> DataFrame:
    """(c, g): the greatest common divisor of each c's g; every batch is reduced before anything is shuffled."""

    def reduced(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            yield rows.groupby("c", as_index=False)["g"].agg(lambda g: np.gcd.reduce(g.to_numpy()))

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": rows["c"].iloc[:1], "g": [np.gcd.reduce(rows["g"].to_numpy())]})

    parts = rows.select("c", F.col("g").cast("long").alias("g")).mapInPandas(reduced, "c long, g long").distinct()
    return parts.groupBy("c").applyInPandas(whole, "c long, g long")


def strong_components(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(v, c) and (v, level) of the vertices on a cycle of two or more; links holds distinct (a, b).

    Rounds of trimming, colouring and walking back. Vertices without a way in or out are trimmed till none is left;
    the greatest vertex that reaches a vertex colours it; the vertices of a colour that reach the one it is named
    after are a component, and c is that vertex. Links between colours and to found vertices go. level is the least
    number of steps to c. The rounds grow with the longest paths among what isn't trimmed.
    """
    rest = scratch.keep(links.filter("a <> b"))
    members = scratch.keep(links.sparkSession.createDataFrame([], "v long, c long, level int"))
    while True:
        rest = _trimmed(rest, scratch)
        if rest.isEmpty():
            break
        colours = _coloured(rest, scratch)
        of = lambda side, name: colours.select(F.col("v").alias(side), F.col("c").alias(name))  # noqa: B023, E731
        same = scratch.keep(rest.join(of("a", "c"), "a").join(of("b", "_c"), "b").filter("c = _c").select("a", "b", "c"))
        reached = _walked_back(same, scratch)
        fresh = reached.select("v")
        left = same.join(fresh.withColumnRenamed("v", "a"), "a", "left_anti").join(fresh.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b")
        longer, kept = scratch.keep(members.unionByName(reached)), scratch.keep(left)
        scratch.drop(rest, members, colours, same, reached)
        members, rest = longer, kept
    return members.select("v", "c"), members.select("v", "level")


def _trimmed(rest: DataFrame, scratch: Scratch) -> DataFrame:
    """The links whose ends both have a way in and a way out, among such links."""
    n = rest.count()
    while n:
        through = rest.select(F.col("a").alias("v")).distinct().join(rest.select(F.col("b").alias("v")).distinct(), "v", "left_semi")
        now = scratch.keep(rest.join(through.withColumnRenamed("v", "a"), "a", "left_semi").join(through.withColumnRenamed("v", "b"), "b", "left_semi").select("a", "b"))
        scratch.drop(rest)
        rest, before, n = now, n, now.count()
        if n == before:
            break
    return rest


def _coloured(rest: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, c): the greatest vertex that reaches v, itself included; only vertices that changed tell the next ones."""
    colours = scratch.keep(rest.select(F.col("a").alias("v")).union(rest.select("b")).distinct().select("v", F.col("v").alias("c"), F.lit(True).alias("new")))
    while True:
        told = rest.join(colours.filter("new").select(F.col("v").alias("a"), "c"), "a").groupBy(F.col("b").alias("v")).agg(F.max("c").alias("_c"))
        now = scratch.keep(colours.join(told, "v", "left").select("v", F.greatest("c", "_c").alias("c"), F.coalesce(F.col("_c") > F.col("c"), F.lit(False)).alias("new")))
        scratch.drop(colours)
        colours = now
        if now.filter("new").isEmpty():
            return colours


def _walked_back(same: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, c, level): the vertices that reach their colour's own vertex over links of one colour, by levels."""
    roots = same.select(F.col("a").alias("v"), "c").union(same.select("b", "c")).filter("v = c").distinct()
    reached = scratch.keep(roots.select("v", "c", F.lit(0).alias("level")))
    depth = 0
    while True:
        edge = reached.filter(F.col("level") == depth).select(F.col("v").alias("b"))
        fresh = same.join(edge, "b", "left_semi").select(F.col("a").alias("v"), "c").distinct().join(reached, "v", "left_anti")
        now = scratch.keep(reached.unionByName(fresh.select("v", "c", F.lit(depth + 1).alias("level"))))
        scratch.drop(reached)
        reached, depth = now, depth + 1
        if now.filter(F.col("level") == depth).isEmpty():
            return reached


def on_cycle(edges: DataFrame, depth: int) -> DataFrame:
    """(state): the states that reach themselves in up to `depth` steps, by path doubling.

    depth: the number of states is enough. Each round joins the pairs found so far with themselves.
    """
    now = edges.select(F.col("from").alias("a"), F.col("to").alias("b")).distinct()
    for _ in range(max(1, depth - 1).bit_length()):
        further = now.alias("x").join(now.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        now = now.union(further).distinct()
    return now.filter("a = b").select(F.col("a").alias("state"))
