"""Order-dependent work (ranks, neighbours) without a global sort in one task.

Rows are dealt into ranges of the order by sampled quantiles of a long column; each range is sorted on its own,
and only one row per range (counts, first and last values) is brought together to line the ranges up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 500_000
#: Ranges at most (beyond, they hold more rows and their sorts spill), and sampled values for each of them.
MAX_RANGES = 20_000
SAMPLED = 32
_MARK = "\x1f"


def number_array(numbers: list[int], kind: str = "bigint") -> Column:
    """Numbers as one array literal: the optimizer folds it from one string, so a plan may hold many."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>") if numbers else F.array().cast(f"array<{kind}>")


def string_array(strings: list[str]) -> Column:
    """The same of strings; those with the character U+001F are left out."""
    strings = [x for x in strings if _MARK not in x]
    return F.split(F.lit(_MARK.join(strings)), _MARK) if strings else F.array().cast("array<string>")


def range_count(df: DataFrame, n: int, rows: int = ROWS_PER_RANGE) -> int:
    """Into how many ranges to deal n rows: a partition each at least, about `rows` in each, MAX_RANGES at most."""
    return max(1, min(n, MAX_RANGES, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))))


def sampled_quantiles(values: DataFrame, n: int, ranges: int) -> list:
    """Values that cut the n rows of a one-column frame into ranges of about equal size; those of a hot value repeat.

    From SAMPLED values for each range, whatever n is. They say where rows go, so nothing depends on which they are.
    """
    want = ranges * SAMPLED
    if ranges < 2 or n == 0:
        return []
    some = values.sample(want / n, seed=1) if want < n else values
    found = sorted(r[0] for r in some.limit(4 * want).collect() if r[0] is not None)
    return [found[len(found) * k // ranges] for k in range(1, ranges)] if found else []


def quantile_bounds(df: DataFrame, order: Column, ranges: int | None = None) -> list[int]:
    """Sorted distinct bounds that cut df's values of `order` into ranges of about equal size."""
    n = df.count()
    return sorted(set(sampled_quantiles(df.select(order), n, ranges or range_count(df, n))))


def range_number(order: Column, bounds: list, or_equal: bool = False) -> Column:
    """How many of the sorted bounds are < the value (or <= it): a binary search in one expression. 0 for a null."""
    if not bounds:
        return F.lit(0)
    steps = number_array([1 << k for k in reversed(range(len(bounds).bit_length()))], "int")
    array = string_array(bounds) if isinstance(bounds[0], str) else number_array(bounds)

    def step(at: Column, by: Column) -> Column:
        there = F.get(array, at + by - 1)
        return F.when(there <= order if or_equal else there < order, at + by).otherwise(at)

    return F.coalesce(F.aggregate(steps, F.lit(0), step), F.lit(0))


def _join(left: DataFrame, right: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """Inner join where nulls are equal; small: right has a row per range at most, so it is broadcast."""
    renamed = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(F.broadcast(renamed) if small else renamed, on).drop(*(f"_r_{k}" for k in keys))


def with_rank(df: DataFrame, keys: list[str], order: list[str], range_col: Column, name: str = "rank") -> DataFrame:
    """df with each row's rank (from 1) within its keys by `order`; range_col must rise with the order.

    A key that holds many rows is ranked in as many parts as there are ranges.
    """
    dealt = df.withColumn("_range", range_col)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    ranked = dealt.withColumn("_place", F.row_number().over(within))
    return _join(ranked, bases, [*keys, "_range"]).withColumn(name, F.col("_place") + F.col("_base")).drop("_range", "_place", "_base")


def with_next(df: DataFrame, order: list[str], value: str, range_col: Column, name: str = "next", keys: list[str] | None = None) -> DataFrame:
    """df's keys, `order` and `value` with the value of the following row of the same keys (null for the last).

    Without keys the following row of the whole order. Rows meet within a range; of each range and key,
    one row (its first value) meets the others' to bridge the bounds.
    """
    keys = keys or []
    dealt = df.select(*dict.fromkeys([*keys, *order, value])).withColumn("_range", range_col)
    first = dealt.groupBy(*keys, "_range").agg(F.min_by(value, F.struct(*order)).alias("_first"))
    after = first.select(*keys, "_range", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_range")).alias("_after"))
    within = Window.partitionBy(*keys, "_range")
    out = dealt.withColumn("_next", F.lead(value).over(within.orderBy(*order))).withColumn("_left", F.count("*").over(within) - F.row_number().over(within.orderBy(*order)))
    joined = _join(out, after, [*keys, "_range"], small=not keys)
    return joined.withColumn(name, F.when(F.col("_left") == 0, F.col("_after")).otherwise(F.col("_next"))).drop("_range", "_next", "_left", "_after")
