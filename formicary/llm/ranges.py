"""Neighbours in the order of an id, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formicary.functions.ordering import number_array, range_count, range_number, sampled_quantiles

ROWS_PER_RANGE = 20_000


def descending_with_next(rows: DataFrame, order_col: str, tie_col: str) -> tuple[DataFrame, int]:
    """rows dealt into descending ranges of order_col (long), each sorted, led by the row that follows it.

    Adds _ghost: 1 marks a copy of the first row of the next range (for the last range: of the first
    row of all), which comes before the range's own rows. Nulls come last, equal ids in the order of
    tie_col. A sample of the ids gives bounds that are ids themselves; one shuffle deals the rows.
    """
    n, top = rows.agg(F.count("*"), F.max(order_col)).first()
    ranges = range_count(rows, n, ROWS_PER_RANGE) if top is not None else 1
    bounds = sorted({x for x in sampled_quantiles(rows.select(order_col), n, ranges) if x < top})
    first = bounds + [top] if top is not None else []  # the largest id of each range
    own = range_number(F.col(order_col), bounds).cast("int")
    dealt = rows.withColumn("_own", own)
    # the largest ids of a range are also the ghosts of the range above it, those of the top one of range 0
    ghost = F.when(F.col(order_col) == F.get(number_array(first), F.col("_own")), F.pmod(F.col("_own") + 1, F.lit(len(first)))) if first else F.lit(None).cast("int")
    spots = F.filter(F.array(F.struct(F.col("_own").alias("range"), F.lit(0).alias("ghost")), F.struct(ghost.cast("int").alias("range"), F.lit(1).alias("ghost"))), lambda x: x["range"].isNotNull())
    spread = dealt.withColumn("_spot", F.explode(spots)).withColumn("_range", F.col("_spot.range")).withColumn("_ghost", F.col("_spot.ghost")).drop("_own", "_spot")
    out = spread.repartitionById(len(bounds) + 1, F.col("_range")).sortWithinPartitions(F.desc("_ghost"), F.desc_nulls_last(order_col), tie_col)
    return out, len(bounds) + 1
