"""Sources and sinks of organism events: generator, files, Kafka, console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formicary.schema import EVENTS, HABITATS, ROLES, SPECIES, encode

# fixed value: the topic of the messages
TOPIC = "insect-events"


def _draw(seed: int, name: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("n"), F.lit(seed), F.lit(name)), F.lit(n))


def generated(spark: SparkSession, n: int, seed: int = 0, start: str = "2024-01-01 00:00:00", mean_gap: float = 0.35) -> DataFrame:
    """n flat events with uniform values, the same for the same seed on any number of executors."""
    seconds = F.floor(F.col("n") * F.lit(mean_gap)).cast("long")
    return _from_numbers(spark.range(n).select(F.col("id").alias("n")), seed, F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + seconds))


def _from_numbers(numbers: DataFrame, seed: int, ts: Column) -> DataFrame:
    def pick(name: str, values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (_draw(seed, name, len(values)) + 1).cast("int"))

    h = F.sha2(F.concat_ws(":", F.lit(seed), "n"), 256)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return numbers.select(
        uuid.alias("id"), pick("species", SPECIES).alias("species"), pick("role", ROLES).alias("role"), (_draw(seed, "age", 10) + 1).cast("int").alias("age"), pick("event", EVENTS).alias("event"),
        ts.alias("ts"), pick("habitat", HABITATS).alias("habitat"),
        (_draw(seed, "lat", 18_000_000) / 100_000 - 90).alias("latitude"), (_draw(seed, "lon", 36_000_000) / 100_000 - 180).alias("longitude"),
        (_draw(seed, "impact", 101) - 50).cast("int").alias("ecological_impact"), (_draw(seed, "density", 1000) + 1).cast("int").alias("population_density"),
    )


def generated_stream(spark: SparkSession, rows_per_second: int = 3, seed: int = 0) -> DataFrame:
    """A stream of events at a set pace, stamped with the time they are made."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return _from_numbers(rows.select(F.col("value").alias("n"), "timestamp"), seed, F.col("timestamp"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages (value) of text files, a JSON object a line."""
    return spark.read.text(path)


def stream_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same as a stream; max_files a trigger sets the pace."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def kafka_messages(spark: SparkSession, servers: str, topic: str = TOPIC, starting: str = "earliest") -> DataFrame:
    """Messages of a Kafka topic as a stream (needs Spark's Kafka package on the class path)."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load().select("value", "partition", "offset", "timestamp")


def to_kafka(events: DataFrame, servers: str, checkpoint: str, topic: str = TOPIC):  # noqa: ANN201  a streaming writer
    """A writer that sends events, as JSON without a key, to a topic; call start() on it."""
    return encode(events).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


def write_messages(events: DataFrame, path: str) -> None:
    """Events as JSON lines."""
    encode(events).write.mode("append").text(path)


def show(rows: DataFrame, n: int = 20) -> None:
    """A table on the console."""
    rows.show(n, truncate=False)
