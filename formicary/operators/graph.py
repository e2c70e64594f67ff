"""The habitat graph and reproducible random walks on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formicary.functions.geo import haversine_km
from formicary.functions.hashing import hash_value

#: fixed value: more than half the Earth's circumference, so the graph is complete unless told otherwise
THRESHOLD_KM = 155_000.0


def vertices(events: DataFrame, order: str = "id") -> DataFrame:
    """(habitat, latitude, longitude): each habitat where it was first seen."""
    placed = events.filter("habitat is not null").groupBy("habitat").agg(F.min_by(F.struct("latitude", "longitude"), order).alias("_p"))
    return placed.select("habitat", "_p.latitude", "_p.longitude")


def edges(places: DataFrame, threshold_km: float = THRESHOLD_KM, distance=haversine_km) -> DataFrame:  # noqa: ANN001  a column function
    """(h1, h2, km) of the pairs h1 < h2 that are near enough.

    Habitats are a vocabulary, not data: one row each, so the theta join is over a handful of rows.
    """
    a = places.select(F.col("habitat").alias("h1"), F.col("latitude").alias("_a1"), F.col("longitude").alias("_o1"))
    b = places.select(F.col("habitat").alias("h2"), F.col("latitude").alias("_a2"), F.col("longitude").alias("_o2"))
    near = a.join(b, F.col("h1") < F.col("h2")).withColumn("km", distance(F.col("_a1"), F.col("_o1"), F.col("_a2"), F.col("_o2")))
    return near.filter(F.col("km") <= threshold_km).select("h1", "h2", "km")


def neighbours(links: DataFrame) -> DataFrame:
    """(habitat, around): the sorted neighbours of each habitat that has any."""
    both = links.select(F.col("h1").alias("habitat"), F.col("h2").alias("_n")).union(links.select("h2", "h1"))
    return both.groupBy("habitat").agg(F.array_sort(F.collect_set("_n")).alias("around"))


def walks(starts: DataFrame, links: DataFrame, steps: int = 5) -> DataFrame:
    """(walk, step, habitat) for starts (walk, habitat): up to `steps` steps to a uniform neighbour.

    The neighbour is drawn by a hash of walk and step, so a walk can be repeated. It ends where there is
    no neighbour. All walks go together, one broadcast-sized join a step and no shuffle of the walks.
    """
    around = neighbours(links)
    at = starts.select("walk", "habitat", F.array("habitat").alias("_path"))
    for step in range(1, steps + 1):
        draw = hash_value(F.col("walk"), F.lit(str(step)))
        to: Column = F.get(F.col("around"), (draw % F.size("around")).cast("int"))
        at = at.join(around, "habitat", "left").select("walk", F.coalesce(to, F.col("habitat")).alias("habitat"), F.when(to.isNull(), F.col("_path")).otherwise(F.concat("_path", F.array(to))).alias("_path"))
    return at.select("walk", F.posexplode("_path").alias("step", "habitat"))


def walk_from(places: DataFrame, links: DataFrame, start: str, walks_: int = 1, steps: int = 5) -> DataFrame:
    """Walks 0.. from one habitat; an unknown one is an error."""
    spark = places.sparkSession
    if places.filter(F.col("habitat") == start).isEmpty():
        raise ValueError(f"unknown habitat {start!r}")
    return walks(spark.range(walks_).select(F.col("id").alias("walk"), F.lit(start).alias("habitat")), links, steps)


def visit_shares(paths: DataFrame) -> DataFrame:
    """(habitat, visits, percent), starts included."""
    counts = paths.groupBy("habitat").agg(F.count("*").alias("visits"))
    total = counts.agg(F.sum("visits").alias("_t"))
    return counts.join(F.broadcast(total)).select("habitat", "visits", (F.col("visits") * 100.0 / F.col("_t")).alias("percent"))


def drawing(places: DataFrame, links: DataFrame, path: DataFrame) -> DataFrame:
    """What a plot of one walk needs: (kind, name, to, latitude, longitude, step) of nodes, edges and path steps.

    Edges and steps have no place of their own; the renderer looks it up among the nodes.
    """
    none = F.lit(None)
    nodes = places.select(F.lit("node").alias("kind"), F.col("habitat").alias("name"), none.cast("string").alias("to"), "latitude", "longitude", none.cast("int").alias("step"))
    edges_ = links.select(F.lit("edge"), "h1", "h2", none.cast("double"), none.cast("double"), none.cast("int"))
    steps = path.select(F.lit("step"), "habitat", none.cast("string"), none.cast("double"), none.cast("double"), F.col("step").cast("int"))
    return nodes.union(edges_).union(steps)


def ranked(weights: DataFrame, weight: str, name: str) -> DataFrame:
    """Rows by falling weight, ties by name, with their position from 1."""
    return weights.orderBy(F.desc(weight), name).withColumn("position", F.row_number().over(Window.orderBy(F.desc(weight), name)))


def described(shares: DataFrame) -> DataFrame:
    """(position, line): visit shares from the most visited on, each as a line such as `forest: 12 (3.50%)`."""
    line = F.format_string("%s: %d (%.2f%%)", "habitat", "visits", F.round("percent", 2))
    return ranked(shares, "visits", "habitat").select("position", line.alias("line"))
