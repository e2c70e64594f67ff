from __future__ import annotations

import random
import time
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from formicary.functions import ordering


@pytest.mark.parametrize("or_equal", [False, True])
@pytest.mark.parametrize("values", [[], [5], [1, 1, 4, 9], ["", "a", "a", "zz", "é"]])
def test_range_number_is_a_binary_search(spark, values, or_equal):
    asked = [None, *(range(-1, 11) if not values or isinstance(values[0], int) else ["", "a", "b", "z", "zz", "é", "ü"])]
    kind = "long" if isinstance(asked[-1], int) else "string"
    cut = bisect_right if or_equal else bisect_left
    rows = spark.createDataFrame([(x,) for x in asked], f"x {kind}").withColumn("n", ordering.range_number(F.col("x"), values, or_equal)).collect()
    key = (lambda x: x) if kind == "long" else str.encode
    assert [r.n for r in rows] == [0, *(cut([key(v) for v in values], key(x)) for x in asked[1:])]


def test_bounds_are_few_and_quick_whatever_the_number_of_rows(spark):
    """The plan for 1e11 rows holds MAX_RANGES bounds and is made in seconds."""
    df = spark.range(10)
    ranges = ordering.range_count(df, 10**11)
    assert ranges == ordering.MAX_RANGES and ordering.range_count(df, 0) == 1
    bounds = sorted(random.Random(1).sample(range(10**12), ranges))
    began = time.perf_counter()
    plan = df.select(ordering.range_number(F.col("id"), bounds).alias("r"), ordering.range_number(F.col("id").cast("string"), [f"{x:012d}" for x in bounds]).alias("s"))
    assert plan.collect()[0].r == 0
    assert time.perf_counter() - began < 20


def test_sampled_quantiles_cut_evenly(spark):
    bounds = ordering.quantile_bounds(spark.range(200_000), F.col("id"), 10)
    sizes = [b - a for a, b in zip([0, *bounds], [*bounds, 200_000], strict=True)]
    assert len(sizes) == 10 and max(sizes) < 45_000
    hot = spark.range(9000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("x"))
    cut = ordering.sampled_quantiles(hot, 9000, 12)
    assert len(cut) == 11 and 6 <= cut.count(7) <= 9
    assert ordering.sampled_quantiles(hot.filter("x is null"), 0, 12) == []
