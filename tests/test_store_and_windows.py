from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from formicary.operators import counts, store, windows
from formicary.schema import decode, encode
from formicary.sources.events import generated, read_messages, show, write_messages

NOW = datetime(2024, 1, 1, 12, 0, 0)
FLAT = "id string, species string, role string, age int, event string, ts timestamp, habitat string, latitude double, longitude double, ecological_impact int, population_density int, seq long"


def event(k, species="ant", role="worker", kind="birth", ago=0, habitat="forest", impact=-5, density=7):
    at = datetime.fromtimestamp(NOW.timestamp() - ago)
    return (str(k), species, role, 3, kind, at, habitat, 1.5, -2.0, impact, density, k)


@pytest.fixture
def events(spark):
    rows = [event(1), event(2, "bee", ago=60), event(3, "bee", "queen", "death", ago=61, habitat="field"), event(4, ago=3600), event(5, "spider", ago=3601), event(6, "ant", ago=-30), event(7, "bee", ago=7200), event(8, "bee", ago=7201)]
    return spark.createDataFrame(rows, FLAT)


def keys(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_recency_includes_its_bound_and_the_future(events):
    assert keys(store.recent(events, 60, NOW)) == ["1", "2", "6"]
    assert store.as_of(events) == datetime.fromtimestamp(NOW.timestamp() + 30)


def test_retention_keeps_the_bound(events):
    kept, removed = store.retain(events, 2, NOW)
    assert keys(removed) == ["8"] and kept.count() == 7


def test_limits(events):
    assert [r.id for r in store.by_species(events, "bee", 2, "seq").collect()] == ["2", "3"]
    assert store.by_species(events, "bee", 0).count() == store.by_species(events, "bee", None).count() == 4
    assert store.by_species(events, "wasp").count() == 0
    assert [r.id for r in store.by_habitat_event(events, "field", "death").collect()] == ["3"]
    with pytest.raises(ValueError, match="negative"):
        store.by_species(events, "bee", -1)
    assert store.impact_and_density(events, 3, "seq").columns == ["id", "ecological_impact", "population_density", "species", "ts"]


def test_upsert_takes_the_last_and_stats_count_each_key_once(spark):
    rows = [event(1, "ant"), event(2, "bee")]
    again = (*event(1, "spider")[:-1], 9)
    last = store.upsert(spark.createDataFrame([*rows, again], FLAT), "id", "seq")
    assert sorted((r.id, r.species) for r in last.collect()) == [("1", "spider"), ("2", "bee")]
    got = {(r.dimension, r.value): r.n for r in store.stats(last).collect()}
    assert got["total", "all"] == 2 and ("species", "ant") not in got
    history = {(r.dimension, r.value): r.n for r in store.stats_with_history(last, spark.createDataFrame([*rows, again], FLAT)).collect()}
    assert history["species", "ant"] == 0


def test_two_meanings_of_the_last_minute(events):
    by_time = windows.group_counts(windows.as_of_windows(events, windows.COUNTER_WINDOWS, NOW))
    assert {(r.window, r.species, r.role): r.n for r in by_time.collect()}["1min", "ant", "worker"] == 2
    arrived = events.withColumn("arrival", F.timestamp_seconds(F.unix_timestamp("ts") + F.when(F.col("seq") == 4, 3601).otherwise(30)))
    at_arrival = windows.arrival_windows(arrived, windows.COUNTER_WINDOWS)
    assert at_arrival.filter("window = '1min'").count() == 7  # counted once and never forgotten; one came too late
    totals = {r.window: r.n for r in windows.window_totals(windows.group_counts(at_arrival)).collect()}
    assert totals == {w: 7 for w in windows.COUNTER_WINDOWS}
    with pytest.raises(windows.UnknownWindow):
        windows.window_seconds("2weeks", windows.LIST_WINDOWS)


def test_lists_keep_the_order_of_arrival(events):
    lists = windows.event_lists(events, "1 day", order="seq")
    got = {(r.species, r.role): r.events for r in lists.collect()}
    assert got["bee", "queen"] == ["death"] and len(got["ant", "worker"]) == 3


def test_map_reduce_does_not_depend_on_its_workers(events):
    one = sorted(map(tuple, counts.map_reduce(events, 1, 1).collect()))
    assert one == sorted(map(tuple, counts.map_reduce(events, 7, 3).collect())) == sorted(map(tuple, counts.map_reduce(events).collect()))
    assert sum(n for _, n in one) == 3 * 8
    assert sorted(map(tuple, counts.merge_counts(counts.map_reduce(events), counts.map_reduce(events)).collect())) == [(i, 2 * n) for i, n in one]
    with pytest.raises(ValueError, match="reduces"):
        counts.map_reduce(events, 1, 0)


def test_score_of_hand_made_rows(spark):
    rows = [event(1, "ant", impact=-50, density=100), event(2, "ant", impact=50, density=300), event(3, "bee", impact=25, density=100), event(4, "spider", impact=1, density=0)]
    got = {r.species: (r.score, r.share) for r in counts.species_score(spark.createDataFrame(rows, FLAT)).collect()}
    assert got["ant"][0] == 5.0 and got["bee"][0] == 5.0 and got["ant"][1] == 0.5 and got["spider"] == (None, None)
    assert counts.species_score(spark.createDataFrame(rows, FLAT), 1, "seq").count() == 1


GOOD = '{"_id":"a","insect":{"species":"ant","role":"queen","age":3},"event":"birth","eventTime":"2024-01-01T00:00:00 Z","location":{"habitat":"forest","coordinates":{"latitude":1.5,"longitude":-2.0}},"ecologicalImpact":-5,"populationDensity":7}'


def test_decode_splits_good_from_bad(spark):
    messages = [
        GOOD, GOOD.replace(" Z", "Z"), GOOD.replace(" Z", ""), GOOD[:-20], GOOD.replace('"event":"birth",', ""), GOOD.replace('"ecologicalImpact":-5', '"ecologicalImpact":"x"'),
        GOOD.replace("2024-01-01T00:00:00 Z", "noon"), GOOD.replace('"age":3', '"age":null'), None, "", "7",
    ]
    good, bad = decode(spark.createDataFrame([(m, k) for k, m in enumerate(messages)], "value string, n int"))
    assert keys(good, "n") == [0, 1, 2, 7]
    assert {str(r.ts) for r in good.collect()} == {"2024-01-01 00:00:00"}
    reasons = {r.n: r.reason for r in bad.collect()}
    assert reasons[4] == "missing event" and reasons[6] == "missing ts" and reasons[3] == reasons[5] == "corrupt" and len(reasons) == 7


def test_generator_is_reproducible_and_round_trips(spark, tmp_path):
    made = generated(spark, 500, seed=3)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, generated(spark, 500, seed=3).repartition(5).collect()))
    assert made.select("id").distinct().count() == 500
    assert made.filter("ecological_impact between -50 and 50 and population_density between 1 and 1000 and age between 1 and 10").count() == 500
    write_messages(made, f"{tmp_path}/m")
    good, bad = decode(read_messages(spark, f"{tmp_path}/m"))
    assert bad.count() == 0 and sorted(map(tuple, good.select(*made.columns).collect())) == sorted(map(tuple, made.collect()))
    assert encode(made).columns == ["value"]


def test_the_console_shows_whole_values(spark, capsys):
    show(spark.createDataFrame([("x" * 60, 1), ("y", 2)], "a string, n int").orderBy("n"), 1)
    said = capsys.readouterr().out
    assert "x" * 60 in said and "only showing top 1 row" in said and "|y" not in said
