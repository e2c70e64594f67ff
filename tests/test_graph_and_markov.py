from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from formicary.functions.geo import haversine_km, vincenty, vincenty_km
from formicary.operators import graph, markov
from formicary.plans.engine import Engine, UnknownRequest
from formicary.sources.events import generated

START = datetime(2024, 1, 1)


def chain_events(spark, events, same=()):
    rows = [(k, e, START + timedelta(seconds=k - (1 if k in same else 0))) for k, e in enumerate(events)]
    return spark.createDataFrame(rows, "id long, event string, ts timestamp")


def edges(pairs):
    return {(r["from"], r["to"]): (r["n"], r["p"]) for r in pairs.collect()}


@pytest.mark.parametrize("parts", ["1", "4", "9"])
def test_transitions_across_ranges(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    names = "abacabbca" * 13
    got = edges(markov.transitions(chain_events(spark, names)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for a, b in zip(names, names[1:], strict=False):
        want[a, b] = want.get((a, b), 0) + 1
    total = {a: sum(n for (x, _), n in want.items() if x == a) for a in names}
    assert got == {k: (n, n / total[k[0]]) for k, n in want.items()}


def test_ties_go_by_the_events_name_and_short_inputs_give_nothing(spark):
    assert edges(markov.transitions(chain_events(spark, "zab", same=(1,)))) == {("a", "z"): (1, 1.0), ("z", "b"): (1, 1.0)}
    for events in ("", "a"):
        chain = markov.transitions(chain_events(spark, events))
        assert chain.collect() == [] and markov.matrix(chain_events(spark, events), chain).collect() == [] and markov.classify(chain).collect() == []
    late = chain_events(spark, "ab").union(spark.createDataFrame([(9, "c", None), (10, None, START)], "id long, event string, ts timestamp"))
    assert edges(markov.transitions(late)) == {("a", "b"): (1, 1.0)}


def test_matrix_has_a_row_of_zeros_for_a_last_state(spark):
    rows = chain_events(spark, "abc")
    got = {(r["from"], r["to"]): r.p for r in markov.matrix(rows, markov.transitions(rows)).collect()}
    assert len(got) == 9 and got["a", "b"] == 1 and all(got["c", x] == 0 for x in "abc")


def classes(pairs, mode="standard"):
    return {c.state: (c.recurrent, c.period, c.ergodic) for c in markov.Chain(pairs).classify(mode)}


def test_periods_and_classes_of_small_graphs():
    assert classes([("0", "1"), ("1", "0")]) == {"0": (True, 2, False), "1": (True, 2, False)}
    both = [("0", "1"), ("1", "0"), ("1", "1")]
    assert classes(both)["0"] == (True, 1, True)
    assert markov.Chain(both).shortest_return_period(0) == 2 and markov.Chain(both).shortest_return_period(1) == 1
    assert classes([("0", "1"), ("1", "1")])["0"][0] is False
    open_ = [("0", "1"), ("0", "0"), ("1", "1")]
    assert classes(open_)["0"][0] is False and classes(open_, "reference")["0"][0] is True
    assert markov.Chain([("0", "1"), ("1", "2"), ("2", "0"), ("2", "1")]).true_period([0, 1, 2]) == 1
    assert classes([(str(k), str((k + 1) % 6)) for k in range(6)])["3"] == (True, 6, False)
    with pytest.raises(ValueError, match="mode"):
        classes(both, "x")


def test_components_list_the_last_visited_first():
    found = markov.Chain([("0", "1"), ("1", "0"), ("1", "1")]).components()
    assert found == [[1, 0]]
    long = [(f"{k:05d}", f"{k + 1:05d}") for k in range(5000)]
    assert len(markov.Chain(long).components()) == 5001


def test_classes_and_cycles_in_spark(spark):
    chain = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 1.0), ("a", "c", 0.4), ("c", "c", 1.0), ("c", "d", 0.1)], "from string, to string, p double")
    got = {r.state: r.recurrent for r in markov.classify(chain, 0.2).collect()}
    assert got == {"a": False, "b": False, "c": True, "d": False}
    assert sorted(r.state for r in markov.on_cycle(chain, 4).distinct().collect()) == ["a", "b", "c"]


def test_classes_by_joins_are_those_of_the_driver(spark):
    rng = random.Random(3)
    ring = [(f"r{k}", f"r{(k + 1) % 6}") for k in range(6)]
    tail = [("r0", "t0"), ("t0", "t1"), ("t1", "u"), ("u", "u"), ("s", "r3")]
    wild = [(f"w{rng.randrange(14)}", f"w{rng.randrange(14)}") for _ in range(22)]
    pairs = sorted({*ring, *tail, *wild, ("x0", "x1"), ("x1", "x0"), ("x1", "x2"), ("x2", "x1")})
    rows = [(a, b, 0.5) for a, b in pairs] + [("lone", "r1", 0.1), (None, "r1", 0.9), ("r1", "lone", None)]
    chain = spark.createDataFrame(rows, "from string, to string, p double")

    def seen(found):
        rows = found.collect()
        named = {}
        for r in rows:
            named.setdefault(r.component, []).append(r.state)
        return sorted((r.state, tuple(sorted(named[r.component])), r.recurrent, r.period, r.aperiodic, r.ergodic) for r in rows)

    joined = markov.classify(chain, 0.2, driver_edges=3)
    assert seen(joined) == seen(markov.classify(chain, 0.2))
    assert joined.schema.simpleString() == markov.classify(chain, 0.2).schema.simpleString()
    assert {r.state: r.period for r in joined.collect()}["r4"] == 6
    with pytest.raises(ValueError, match="reference mode"):
        markov.classify(chain, 0.2, mode="reference", driver_edges=3)


def test_user_chains(spark):
    rows = chain_events(spark, "abab").withColumn("u", F.col("id") % 2)
    assert {(r.u, r["from"], r["to"]) for r in markov.keyed_transitions(rows, ["u"]).collect()} == {(0, "a", "a"), (1, "b", "b")}
    none = chain_events(spark, "abc").withColumn("u", F.lit(None).cast("int"))
    assert {(r.u, r["from"], r["to"]) for r in markov.keyed_transitions(none, ["u"]).collect()} == {(None, "a", "b"), (None, "b", "c")}


def places(spark):
    return spark.createDataFrame([("forest", 0.0, 0.0), ("field", 0.0, 1.0), ("house", 0.0, 90.0), ("garden", 50.0, 10.0)], "habitat string, latitude double, longitude double")


def test_edges_by_distance(spark):
    near = graph.edges(places(spark), 200.0).collect()
    assert [(r.h1, r.h2) for r in near] == [("field", "forest")] and abs(near[0].km - 111.195) < 0.01
    assert graph.edges(places(spark)).count() == 6


def test_ellipsoidal_distance(spark):
    assert abs(vincenty(0, 0, 0, 1) - 111.3195) < 1e-3 and vincenty(1, 1, 1, 1) == 0
    assert abs(vincenty(50.06632, -5.71475, 58.64402, -3.07009) - 969.954) < 0.01
    row = spark.range(1).select(vincenty_km(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("v"), haversine_km(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("h")).first()
    assert abs(row.v - row.h) / row.v < 0.006
    odd = spark.createDataFrame([(0, None, 1.0), (1, 0.0, 0.0), (2, 0.0, 179.9)], "k int, a double, b double").select("k", vincenty_km(F.lit(0.0), "a", F.lit(0.0), "b").alias("v"))
    assert {r.k: r.v for r in odd.collect()} == {0: None, 1: 0.0, 2: None}  # a null, the same place, nearly opposite ones
    assert vincenty(0, 0, 0, 179.9) is None


def test_walks_follow_edges_and_stop_at_dead_ends(spark):
    links = graph.edges(places(spark), 200.0)
    paths = graph.walks(spark.createDataFrame([(0, "forest"), (1, "house")], "walk long, habitat string"), links, 5).orderBy("walk", "step").collect()
    assert [r.habitat for r in paths if r.walk == 0] == ["forest", "field"] * 3 and [r.habitat for r in paths if r.walk == 1] == ["house"]
    all_ = graph.edges(places(spark))
    near = {tuple(sorted((r.h1, r.h2))) for r in all_.collect()}
    steps = graph.walk_from(places(spark), all_, "forest", 20, 5).orderBy("walk", "step").collect()
    assert len(steps) == 120 and all(tuple(sorted((a.habitat, b.habitat))) in near for a, b in zip(steps, steps[1:], strict=False) if a.walk == b.walk)
    shares = graph.visit_shares(graph.walk_from(places(spark), all_, "forest", 20, 5)).collect()
    assert abs(sum(r.percent for r in shares) - 100) < 1e-9
    assert [r.habitat for r in graph.ranked(spark.createDataFrame([("a", 1), ("c", 2), ("b", 2)], "habitat string, visits int"), "visits", "habitat").orderBy("position").collect()] == ["b", "c", "a"]
    drawn = graph.drawing(places(spark), all_, graph.walk_from(places(spark), all_, "forest")).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in drawn} == {"node": 4, "edge": 6, "step": 6}
    with pytest.raises(ValueError, match="unknown habitat"):
        graph.walk_from(places(spark), links, "moon")


def test_every_request_of_the_engine(spark):
    engine = Engine(generated(spark, 400, seed=1), seq="ts")
    asked = {
        "stats": {}, "species": {"species": "ant"}, "habitat_event": {"habitat": "forest", "event": "birth"}, "eco_density": {}, "cantidad": {}, "bloom_filter": {"species": "ant", "role": "queen", "event": "birth"},
        "minwise": {"species": "ant", "role": "queen", "mode": "reference"}, "hyperloglog": {}, "dgim_filter": {}, "random_walk": {"start": "forest", "walks": 3}, "pagerank": {"limit": 10}, "mapreduce": {}, "markov": {"what": "classes"},
    }
    for kind, params in asked.items():
        assert engine.run(kind, **params).count() > 0, kind
    assert set(asked) == set(engine.requests)
    assert engine.run("hyperloglog").first()[0] == 4
    with pytest.raises(UnknownRequest):
        engine.run("drop")
    with pytest.raises(ValueError, match="unknown window"):
        engine.run("cantidad", window="9min")


def test_long_cycles_are_found(spark):
    import datetime as dt

    from formicary.plans import queries

    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(minutes=k), f"e{k % 12:02}") for k in range(37)]
    org = spark.createDataFrame(rows, "ts timestamp, event string")
    found = getattr(queries.recurrent_states, "__wrapped__", queries.recurrent_states)(org)
    assert sorted(r.state for r in found.collect()) == [f"e{k:02}" for k in range(12)]
