"""Map/combine/reduce counts and the species score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the counts are taken of, each value prefixed by the column's name.
COUNTED = ("species", "role", "event")


def map_reduce(events: DataFrame, maps: int | None = None, reduces: int | None = None, columns: tuple[str, ...] = COUNTED) -> DataFrame:
    """(item, n) for items like `species:ant`.

    Spark's partial and final aggregation are the combiner and the reducer. maps and reduces set the
    partitions before and after the shuffle; the counts don't depend on them. Both must be at least 1.
    """
    for name, n in (("maps", maps), ("reduces", reduces)):
        if n is not None and n < 1:
            raise ValueError(f"{name} must be at least 1: {n}")
    rows = events.repartition(maps) if maps else events
    items = rows.select(F.explode(F.array(*(F.concat(F.lit(f"{c}:"), F.col(c)) for c in columns))).alias("item")).filter("item is not null")
    counts = items.groupBy("item").agg(F.count("*").alias("n"))
    return counts.coalesce(reduces) if reduces else counts


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Adds up (item, n) tables."""
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.groupBy("item").agg(F.sum("n").alias("n"))


def ratio_to_total(value: Column) -> Column:
    """A row's share of the column's total; null where the total is 0."""
    return F.try_divide(value, F.sum(value).over(Window.partitionBy()))


def species_score(events: DataFrame, limit: int | None = None, order: str = "id") -> DataFrame:
    """(species, avg_impact, avg_density, score, share): mean |impact| / 50 * 1000 / mean density.

    limit: only the first rows by `order` (10 is what the interactive query used); default: all rows. A density
    of 0 gives a null score. The share is taken over the species, a handful of rows.
    """
    rows = events.select("species", "ecological_impact", "population_density", order)
    if limit:
        rows = rows.orderBy(order).limit(limit)
    means = rows.groupBy("species").agg(F.avg(F.abs("ecological_impact")).alias("avg_impact"), F.avg("population_density").alias("avg_density"))
    scored = means.withColumn("score", (F.col("avg_impact") / 50) * F.try_divide(F.lit(1000.0), F.col("avg_density")))
    return scored.withColumn("share", ratio_to_total(F.col("score")))
