"""The organism event: its JSON schema, its flat form, and the events table seen as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the vocabulary and the field names of the messages
SPECIES = ["ant", "bee", "butterfly", "spider"]
ROLES = ["worker", "queen", "soldier", "scout"]
EVENTS = ["birth", "death", "predator attack"]
HABITATS = ["forest", "field", "garden", "house"]
CORRUPT = "_corrupt_record"

EVENT_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("insect", T.StructType([T.StructField("species", T.StringType()), T.StructField("role", T.StringType()), T.StructField("age", T.IntegerType())])),
    T.StructField("event", T.StringType()),
    T.StructField("eventTime", T.StringType()),
    T.StructField("location", T.StructType([
        T.StructField("habitat", T.StringType()),
        T.StructField("coordinates", T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])),
    ])),
    T.StructField("ecologicalImpact", T.IntegerType()),
    T.StructField("populationDensity", T.IntegerType()),
])

#: What a message must have; age and coordinates may be missing.
REQUIRED = ["id", "species", "role", "habitat", "event", "ts", "ecological_impact", "population_density"]
#: The columns of a flat event.
FLAT = ["id", "species", "role", "age", "event", "ts", "habitat", "latitude", "longitude", "ecological_impact", "population_density"]


def parse_time(text: Column) -> Column:
    """`2024-01-01T00:00:00 Z`, `...00Z`, `...00`, or with an offset such as `...00+02:00`, as a UTC timestamp; else null."""
    plain = F.regexp_replace(text, r"\s*Z$", "")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def flatten(nested: DataFrame) -> DataFrame:
    """The flat columns of rows with EVENT_SCHEMA's fields; further columns follow."""
    fields = {f.name for f in EVENT_SCHEMA.fields}
    rest = [c for c in nested.columns if c not in fields]
    return nested.select(
        F.col("_id").alias("id"), F.col("insect.species").alias("species"), F.col("insect.role").alias("role"), F.col("insect.age").alias("age"), "event",
        parse_time(F.col("eventTime")).alias("ts"), F.col("location.habitat").alias("habitat"), F.col("location.coordinates.latitude").alias("latitude"),
        F.col("location.coordinates.longitude").alias("longitude"), F.col("ecologicalImpact").alias("ecological_impact"), F.col("populationDensity").alias("population_density"), *rest,
    )


def judged(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON messages parsed once: the flat event, _message and _reason, which is null for a good event.

    Otherwise _reason says `corrupt`, or which of REQUIRED are missing. Other columns of messages pass through.
    """
    with_bad = T.StructType([*EVENT_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    rest = [c for c in messages.columns if c != value]
    record = F.from_json("_message", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # the generator is a barrier: without it the optimizer copies the parser into every field and filter
    parsed = messages.select(*rest, F.col(value).cast("string").alias("_message")).withColumn("_r", F.explode(F.array(record)))
    flat = flatten(parsed.select("_r.*", "_message", *rest))
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED)), lambda x: x.isNotNull()), ",")
    reason = F.when(F.col(CORRUPT).isNotNull() | F.col("_message").isNull(), F.lit("corrupt")).when(missing != "", F.concat(F.lit("missing "), missing))
    return flat.withColumn("_reason", reason).drop(CORRUPT)


def split_judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of `judged` rows."""
    rest = [c for c in rows.columns if c not in FLAT and c not in ("_message", "_reason")]
    good = rows.filter("_reason is null").drop("_reason", "_message")
    return good, rows.filter("_reason is not null").select(F.col("_message").alias("message"), F.col("_reason").alias("reason"), *rest)


def decode(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of JSON messages.

    A dead letter is JSON that doesn't parse, or an event without one of REQUIRED; it keeps the message
    and says why. Other columns of messages pass through (on both sides). Who wants both sides in one pass
    keeps what `judged` gives.
    """
    return split_judged(judged(messages, value))


def encode(events: DataFrame) -> DataFrame:
    """Flat events as JSON messages (value)."""
    nested = events.select(
        F.col("id").cast("string").alias("_id"), F.struct("species", "role", "age").alias("insect"), "event", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss' Z'").alias("eventTime"),
        F.struct("habitat", F.struct("latitude", "longitude").alias("coordinates")).alias("location"), F.col("ecological_impact").alias("ecologicalImpact"), F.col("population_density").alias("populationDensity"),
    )
    return nested.select(F.to_json(F.struct("*")).alias("value"))


def organisms(events: DataFrame) -> DataFrame:
    """The generic events table as organism events: id (also the order of arrival), ts, event, ..."""
    k = F.get_json_object("props", "$.k").cast("int")
    by_user = F.element_at(F.array(*map(F.lit, SPECIES)), (F.col("user_id") % 4 + 1).cast("int"))
    by_role = F.element_at(F.array(*map(F.lit, ROLES)), (F.floor(F.col("user_id") / 4) % 4 + 1).cast("int"))
    by_event = F.element_at(F.array(*map(F.lit, HABITATS)), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("event"), "user_id", by_user.alias("species"), by_role.alias("role"), by_event.alias("habitat"), (F.lit(1) + F.col("user_id") % 10).cast("int").alias("age"),
        (k - 50).alias("ecological_impact"), (1 + 10 * k).alias("population_density"), ((F.col("event_id") * 37 % 18000).cast("double") / 100 - 90).alias("latitude"), ((F.col("event_id") * 91 % 36000).cast("double") / 100 - 180).alias("longitude"),
    )

