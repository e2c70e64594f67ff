"""Streams of organism events: ingest with dead letters, upserts, window counts, retention, transitions.

Streams that have event times use watermarks on a UTC timestamp. Every writer takes a checkpoint folder,
so a restart goes on where the last one ended.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from formicary.operators.sketches import Dgim
from formicary.operators.store import age_seconds
from formicary.schema import judged, split_judged
from formicary.shipping import ship


def ingest(messages: DataFrame, good_path: str, bad_path: str, checkpoint: str, value: str = "value", **trigger):  # noqa: ANN201  a streaming query
    """Decode messages and append events and dead letters as Parquet; returns the started query.

    Each micro-batch is decoded once and kept for both writes; the batch number is a partition column,
    so a batch that is repeated after a failure replaces its own rows.
    """

    def both(batch: DataFrame, number: int) -> None:
        rows = judged(batch, value).persist()
        try:
            good, bad = split_judged(rows)
            good.write.mode("overwrite").parquet(f"{good_path}/batch={number}")
            bad.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        finally:
            rows.unpersist()

    return messages.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Runs of one level that are merged into one of the next.
FAN = 8


def upserting(events: DataFrame, path: str, checkpoint: str, key: str = "id", seq: str = "ts", keep_hours: float | None = None, ts: str = "ts", **trigger):  # noqa: ANN201
    """Keep the last row of each key under path, as one version after another; returns the query.

    A batch is written as a run of its own; when there are FAN runs of a level they are merged into one of the
    next, so a row is rewritten once a level and a version is some FAN runs a level. A version is a list of runs,
    which counts once it is there in full; `latest_version` merges them for a reader. The lists of the last two
    versions and their runs stay, for readers that are at the one before; older ones go. Among rows of a key with
    equal seq that of the latest batch stays (within a batch: any); a null seq is less than any other. A path
    belongs to one checkpoint folder.
    keep_hours: rows whose time is longer ago by the clock of the batch, or null, are in no version; their space is free
    when their run is the oldest and all of it is old, or when all runs are merged.
    """
    spark = events.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        if number in versions(spark, path):  # written before a failure that lost the commit
            return
        before = _manifest(spark, path, number)
        runs, taken, level = (before["runs"] if before else []), [], 0
        while len(runs) >= FAN - 1 and all(r["level"] == level for r in runs[1 - FAN :]):
            runs, taken, level = runs[: 1 - FAN], runs[1 - FAN :] + taken, level + 1
        clock = time.time_ns() // 1000
        book = {"key": key, "seq": seq, "ts": ts, "keep_hours": keep_hours, "clock": clock}
        last = _last_rows([*_read_runs(spark, path, taken), batch], key, seq)
        name = f"run-{taken[0]['first'] if taken else number:012d}-{number:012d}"
        (last if runs else _kept(last, book)).write.mode("overwrite").parquet(f"{path}/{name}")
        run = {"name": name, "first": taken[0]["first"] if taken else number, "level": level}
        if keep_hours is not None:
            run["newest"] = spark.read.schema(last.schema).parquet(f"{path}/{name}").agg(F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()[0]
            while runs and "newest" in runs[0] and (runs[0]["newest"] is None or clock - runs[0]["newest"] > keep_hours * 3_600_000_000):
                runs = runs[1:]
        _publish(spark, path, number, {**book, "schema": last.schema.json(), "runs": [*runs, run]})
        _clean(spark, path)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _files(spark: SparkSession, path: str):  # noqa: ANN202  Hadoop's file system and path
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _last_rows(parts: list[DataFrame], key: str, seq: str) -> DataFrame:
    """The last row of each key by (seq, part): one aggregation with partial results."""
    columns = parts[0].columns
    rows = reduce(DataFrame.unionByName, [df.select(F.struct(*columns).alias("row"), F.lit(k).alias("part")) for k, df in enumerate(parts)])
    return rows.groupBy(F.col(f"row.`{key}`").alias("key")).agg(F.max_by("row", F.struct(f"row.`{seq}`", "part")).alias("row")).select("row.*")


def _kept(rows: DataFrame, book: dict) -> DataFrame:
    """The rows that are not too old by the clock of a version."""
    if book["keep_hours"] is None:
        return rows
    return rows.filter(~(age_seconds(F.timestamp_micros(F.lit(book["clock"])), book["ts"]) > book["keep_hours"] * 3600))


def _read_runs(spark: SparkSession, path: str, runs: list[dict], schema: StructType | None = None) -> list[DataFrame]:
    reader = spark.read.schema(schema) if schema else spark.read
    return [reader.parquet(f"{path}/{r['name']}") for r in runs]


def _publish(spark: SparkSession, path: str, number: int, book: dict) -> None:
    """Write the list of a version's runs; it appears under its name at once and in full."""
    fs, part = _files(spark, f"{path}/_part-{number:012d}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(book).encode()))
    out.close()
    if not fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version-{number:012d}")):
        raise OSError(f"version {number} of {path} can't be published")


def _manifest(spark: SparkSession, path: str, below: int | None = None) -> dict | None:
    numbers = [n for n in versions(spark, path) if below is None or n < below]
    return json.loads(spark.read.text(f"{path}/version-{numbers[-1]:012d}", wholetext=True).first()[0]) if numbers else None


def _clean(spark: SparkSession, path: str) -> None:
    """Delete the lists before the last two, and the runs that are in neither of those."""
    fs, root = _files(spark, path)
    last = [f"version-{n:012d}" for n in versions(spark, path)[-2:]]
    used = {r["name"] for n in last for r in json.loads(spark.read.text(f"{path}/{n}", wholetext=True).first()[0])["runs"]}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if (name.startswith("version-") and name not in last) or (name.startswith("run-") and name not in used):
            fs.delete(status.getPath(), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole versions under path, rising."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n.rpartition("-")[2]) for n in names if n.startswith("version-"))


def latest_version(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest whole version under path (below a number), None if there is none.

    Its runs are merged by key, one shuffle; a version of one run is read as it is.
    """
    book = _manifest(spark, path, below)
    if book is None:
        return None
    parts = _read_runs(spark, path, book["runs"], StructType.fromJson(json.loads(book["schema"])))
    return _kept(parts[0] if len(parts) == 1 else _last_rows(parts, book["key"], book["seq"]), book)


def timed(events: DataFrame, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Events with `ts` as a UTC timestamp under a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def window_counts(events: DataFrame, length: str, slide: str | None = None, keys: tuple[str, ...] = ("species", "role"), ts: str = "ts") -> DataFrame:
    """(window_start, keys..., n) by tumbling or hopping event-time windows; also on batches."""
    cut = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.groupBy(cut.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def window_lists(events: DataFrame, length: str, keys: tuple[str, ...] = ("species", "role"), ts: str = "ts") -> DataFrame:
    """(window_start, keys..., events) by tumbling windows, each list sorted by time, then event."""
    rows = events.groupBy(F.window(ts, length).alias("w"), *keys).agg(F.array_sort(F.collect_list(F.struct(ts, "event"))).alias("_l"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, F.transform("_l", lambda x: x["event"]).alias("events"))


def running_counts(events: DataFrame, keys: tuple[str, ...] = ("species", "role")) -> DataFrame:
    """(keys..., n) over all so far; use update or complete mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def not_too_late(events: DataFrame, seconds: int = 3600, ts: str = "ts") -> DataFrame:
    """Events at most so late by the clock, exactly; the watermark alone follows the latest event."""
    return events.filter(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.col(ts).cast("timestamp")) <= seconds)


_COUNTER = "key string, ones long, estimate long"


def _count_window(seconds: int):  # noqa: ANN202
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, sizes, ones = state.get if state.exists else ([], [], 0)
        counter = Dgim(seconds, list(zip(times, sizes, strict=True)))
        rows = pd.concat(list(parts)).sort_values(["t", "bit"])
        for t, bit in zip(rows["t"], rows["bit"], strict=True):
            counter.add(int(bit), float(t))
        ones += int(rows["bit"].sum())
        state.update(([t for t, _ in counter.buckets], [s for _, s in counter.buckets], ones))
        yield pd.DataFrame({"key": [key[0]], "ones": [ones], "estimate": [counter.estimate()]})

    return step


def dgim_counts(bits: DataFrame, seconds: int, key: str, bit: str, ts: str = "ts") -> DataFrame:
    """(key, ones, estimate): a DGIM counter for each key, kept as state of logarithmic size."""
    rows = bits.select(F.col(key).cast("string").alias("key"), F.unix_timestamp(F.col(ts).cast("timestamp")).cast("double").alias("t"), F.col(bit).cast("int").alias("bit"))
    ship(rows.sparkSession)
    return rows.groupBy("key").applyInPandasWithState(_count_window(seconds), _COUNTER, "times array<double>, sizes array<long>, ones long", "update", GroupStateTimeout.NoTimeout)


def _pair_up(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(parts)).sort_values(["t", "event"])
    events = ([state.get[0]] if state.exists else []) + rows["event"].tolist()
    state.update((events[-1],))
    yield pd.DataFrame({"key": [key[0]] * (len(events) - 1), "from": events[:-1], "to": events[1:]})


def stream_transitions(events: DataFrame, key: str, event: str = "event", ts: str = "ts") -> DataFrame:
    """(key, from, to) for consecutive events of each key; the last event is kept between batches.

    Within a batch events are ordered by time; batches are taken to follow each other.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(event).alias("event")).filter("t is not null and event is not null")
    ship(rows.sparkSession)
    return rows.groupBy("key").applyInPandasWithState(_pair_up, "key string, from string, to string", "last string", "append", GroupStateTimeout.NoTimeout)


def chain_of(pairs: DataFrame) -> DataFrame:
    """(from, to, n, p) of collected transitions."""
    counts = pairs.groupBy("from", "to").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


class Progress(StreamingQueryListener):
    """Keeps the last progress reports: batch, rows in, rows a second."""

    def __init__(self, keep: int = 100) -> None:
        self.keep, self.reports = keep, []

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.reports = [*self.reports, (p.batchId, p.numInputRows, p.processedRowsPerSecond)][-self.keep :]

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass
