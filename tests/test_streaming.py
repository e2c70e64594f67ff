from __future__ import annotations

import time

from pyspark.sql import functions as F

from formicary.operators.markov import keyed_transitions
from formicary.operators.sketches import Dgim
from formicary.schema import decode
from formicary.sources.events import generated, generated_stream, stream_messages, write_messages
from formicary.streaming import streams


def messages(spark, tmp_path, batches=3, n=200):
    made = generated(spark, batches * n, seed=5, mean_gap=10.0).orderBy("ts")
    for k in range(batches):
        low = made.filter(F.col("ts") >= F.timestamp_seconds(F.lit(1704067200 + k * n * 10))).filter(F.col("ts") < F.timestamp_seconds(F.lit(1704067200 + (k + 1) * n * 10)))
        write_messages(low.coalesce(1), f"{tmp_path}/in")
    return made


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive


def test_ingest_splits_and_goes_on_after_a_restart(spark, tmp_path):
    made = messages(spark, tmp_path, 2)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(f"{tmp_path}/in")
    for _ in range(2):
        finish(streams.ingest(stream_messages(spark, f"{tmp_path}/in", 1), f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/ck"))
        assert spark.read.parquet(f"{tmp_path}/good").count() == made.count() == 400
        assert [r.message for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["{broken"]


def collected(spark, df, name, mode):
    finish(df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start())
    return spark.table(name)


def test_windows_of_the_stream_are_those_of_the_batch(spark, tmp_path):
    made = messages(spark, tmp_path)
    good, _ = decode(stream_messages(spark, f"{tmp_path}/in", 1))
    live = collected(spark, streams.window_counts(streams.timed(good), "10 minutes"), "counts", "complete")
    want = sorted(map(tuple, streams.window_counts(made, "10 minutes").collect()))
    assert sorted(map(tuple, live.collect())) == want
    closed = collected(spark, streams.window_counts(streams.timed(good, "1 minute"), "10 minutes"), "closed", "append").collect()
    assert set(map(tuple, closed)) < set(want) and len(closed) > len(want) / 2
    lists = collected(spark, streams.window_lists(streams.timed(good), "1 hour"), "lists", "complete")
    assert sorted(map(str, lists.collect())) == sorted(map(str, streams.window_lists(made, "1 hour").collect()))
    assert sorted(map(tuple, collected(spark, streams.running_counts(good), "running", "complete").collect())) == sorted(map(tuple, streams.running_counts(made).collect()))


def test_upserts_keep_the_last(spark, tmp_path):
    for k, text in enumerate(["a", "b", "c"]):
        spark.createDataFrame([(1, text, k), (10 + k, text, k)], "id long, text string, seq long").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    rows = spark.readStream.schema("id long, text string, seq long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    finish(streams.upserting(rows, f"{tmp_path}/out", f"{tmp_path}/ck", seq="seq"))
    got = {r.id: r.text for r in streams.latest_version(spark, f"{tmp_path}/out").collect()}
    assert got == {1: "c", 10: "a", 11: "b", 12: "c"}
    assert streams.latest_version(spark, f"{tmp_path}/none") is None
    assert streams.versions(spark, f"{tmp_path}/out") == [1, 2]
    dated = spark.readStream.schema("id long, text string, seq long").json(f"{tmp_path}/in").withColumn("ts", F.when(F.col("id") == 1, F.current_timestamp()).otherwise(F.to_timestamp(F.lit("2024-01-01"))))
    finish(streams.upserting(dated, f"{tmp_path}/kept", f"{tmp_path}/ck2", seq="seq", keep_hours=2))
    assert [r.id for r in streams.latest_version(spark, f"{tmp_path}/kept").collect()] == [1]


def test_runs_are_merged_by_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FAN", 3)
    want = {}
    for k in range(10):
        rows = [(1, f"a{k}", k), (2, f"b{k}", 7), (20 + k, f"c{k}", k), (3, f"d{k}", 9 - k), (4, f"e{k}", None)]
        spark.createDataFrame(rows, "id long, text string, seq long").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        time.sleep(0.05)  # files are taken by their time
        want |= {1: f"a{k}", 2: f"b{k}", 20 + k: f"c{k}", 3: "d0", 4: f"e{k}"}
    rows = spark.readStream.schema("id long, text string, seq long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    finish(streams.upserting(rows, f"{tmp_path}/out", f"{tmp_path}/ck", seq="seq"))
    got = streams.latest_version(spark, f"{tmp_path}/out").collect()
    assert {r.id: r.text for r in got} == want and len(got) == len(want)
    names = sorted(f.name for f in tmp_path.joinpath("out").iterdir() if f.name.startswith("run-"))
    assert names == ["run-000000000000-000000000008", "run-000000000009-000000000009"]
    assert {r.id: r.text for r in streams.latest_version(spark, f"{tmp_path}/out", 9).collect()}[1] == "a8"


def test_old_runs_leave_with_the_clock(spark, tmp_path):
    for k, hours in enumerate([30, 20, 1]):
        spark.createDataFrame([(k, hours), (9, hours)], "id long, hours int").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        time.sleep(0.05)
    rows = spark.readStream.schema("id long, hours int").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    dated = rows.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.current_timestamp()) - F.col("hours") * 3600))
    finish(streams.upserting(dated, f"{tmp_path}/out", f"{tmp_path}/ck", keep_hours=10))
    assert sorted((r.id, r.hours) for r in streams.latest_version(spark, f"{tmp_path}/out").collect()) == [(2, 1), (9, 1)]
    assert len(streams._manifest(spark, f"{tmp_path}/out")["runs"]) == 1


def test_counters_and_transitions_keep_state_between_batches(spark, tmp_path):
    made = messages(spark, tmp_path)
    good, _ = decode(stream_messages(spark, f"{tmp_path}/in", 1))
    bits = good.withColumn("bit", F.when(F.col("event") == "predator attack", 1).otherwise(0))
    live = {}
    finish(streams.dgim_counts(bits, 1500, "species", "bit").writeStream.foreachBatch(lambda b, _: live.update({r.key: r.estimate for r in b.collect()})).outputMode("update").trigger(availableNow=True).start())
    counters = {}
    for r in made.orderBy("ts").collect():
        counters.setdefault(r.species, Dgim(1500)).add(int(r.event == "predator attack"), r.ts.timestamp())
    assert live == {s: c.estimate() for s, c in counters.items()}
    pairs = collected(spark, streams.stream_transitions(good, "species"), "pairs", "append")
    got = {(r.key, r["from"], r["to"]): r["count"] for r in pairs.groupBy("key", "from", "to").count().collect()}
    assert got == {(r.species, r["from"], r["to"]): r.n for r in keyed_transitions(made, ["species"]).collect()}
    assert streams.chain_of(pairs).count() == 9


def test_generated_stream_has_the_schema(spark):
    stream = generated_stream(spark, 2)
    assert stream.isStreaming and stream.columns == generated(spark, 1).columns
    assert streams.not_too_late(generated(spark, 3)).count() == 0


class Recorder:
    """Stands for a reader or writer: notes the format and the options that it is given."""

    def __init__(self):
        self.seen = {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def option(self, key, value):
        self.seen[key] = value
        return self

    def load(self):
        return self

    def select(self, *columns):
        self.seen["columns"] = columns
        return self


def test_kafka_source_and_sink_options(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from pyspark.sql import DataFrame

    from formicary.sources import events as sources

    reader = Recorder()
    sources.kafka_messages(SimpleNamespace(readStream=reader), "host:9092", starting="latest")
    assert reader.seen == {"format": "kafka", "kafka.bootstrap.servers": "host:9092", "subscribe": "insect-events", "startingOffsets": "latest", "columns": ("value", "partition", "offset", "timestamp")}
    writer, sent = Recorder(), []
    monkeypatch.setattr(DataFrame, "writeStream", property(lambda df: sent.append(df) or writer), raising=False)
    for owner in type(spark.range(1)).__mro__:
        if "writeStream" in vars(owner):
            monkeypatch.setattr(owner, "writeStream", property(lambda df: sent.append(df) or writer))
    sources.to_kafka(generated(spark, 3), "host:9092", f"{tmp_path}/ck")
    assert writer.seen == {"format": "kafka", "kafka.bootstrap.servers": "host:9092", "topic": "insect-events", "checkpointLocation": f"{tmp_path}/ck"}
    assert sent[0].columns == ["value"] and '"species"' in sent[0].first().value


def test_times_with_and_without_an_offset(spark):
    from formicary.schema import parse_time

    asked = ["2024-01-01T00:00:00 Z", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "2024-01-01T02:00:00+02:00", "2023-12-31T19:30:00-04:30", "2024-01-01", "soon", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(asked)], "k int, x string").orderBy("k")
    got = [r[0] for r in rows.select(F.unix_timestamp(parse_time(F.col("x")))).collect()]
    assert got == [1704067200] * 5 + [None] * 3


def test_progress_keeps_the_last_reports(spark, tmp_path):
    messages(spark, tmp_path, 3)
    progress = streams.Progress(keep=2)
    spark.streams.addListener(progress)
    try:
        finish(streams.ingest(stream_messages(spark, f"{tmp_path}/in", 1), f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/ck"))
        until = time.time() + 30
        while (not progress.reports or progress.reports[-1][0] < 2) and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert [r[:2] for r in progress.reports] == [(1, 200), (2, 200)]
    assert all(rate > 0 for _, _, rate in progress.reports)
