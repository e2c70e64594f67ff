from __future__ import annotations

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formicary.functions.hashing import murmur3, murmur3_32, murmur3_array
from formicary.operators import sketches


@pytest.mark.parametrize(("n", "size"), [(0, (0, 0)), (1, (7, 4)), (10, (72, 4)), (100, (729, 5)), (857, (6254, 5))])
def test_bloom_sizing(n, size):
    assert sketches.bloom_size(n) == size


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(600).select(F.concat(F.lit("k"), "id").alias("key"))
    bits, hashes = sketches.bloom_size(600)
    built = sketches.bloom_build(keys, "key", bits, hashes)
    assert sketches.bloom_probe(keys, "key", built, bits, hashes).filter("not maybe").count() == 0
    others = spark.range(4000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert sketches.bloom_probe(others, "key", built, bits, hashes).filter("maybe").count() < 4000 * 0.06
    empty = sketches.bloom_build(keys.limit(0), "key", 0, 0)
    assert empty.count() == 0 and sketches.bloom_probe(others, "key", empty, 0, 0).filter("maybe").count() == 0


def test_minhash_is_within_three_sigma(spark):
    ids = spark.range(300).select(F.col("id").cast("string").alias("key"), "id")
    one = sketches.minhash(ids.filter("id < 200").withColumn("s", F.lit("a")), ["s"], "key")
    two = sketches.minhash(ids.filter("id >= 100").withColumn("s", F.lit("b")), ["s"], "key")
    got = sketches.jaccard(one, two).first()[0]
    assert abs(got - 1 / 3) <= 3 * math.sqrt(1 / 3 * 2 / 3 / 128)
    assert sketches.pairwise_jaccard(one.union(two), "s").first()[2] == got
    nothing = one.limit(0)
    assert sketches.jaccard(nothing, nothing).first()[0] == 1.0 and sketches.jaccard(one, nothing).first()[0] == 0.0


def test_redundancy_and_sample(spark):
    window = spark.createDataFrame([("ant_queen_0",)], "key string")
    asked = spark.createDataFrame([("ant_queen_0",), ("bee_queen_0",)], "key string")
    got = {r.key: (r.similarity, r.label) for r in sketches.redundancy(window, asked, "key").collect()}
    assert got == {"ant_queen_0": (1.0, "redundant"), "bee_queen_0": (0.0, "new")}
    assert {r.label for r in sketches.redundancy(window.limit(0), asked, "key").collect()} == {"new"}
    rows = spark.createDataFrame([("x", 5), ("x", 2), ("y", 3)], "key string, id long")
    sample = sketches.representatives(rows, "key", "id", 10).collect()
    assert len(sample) == 10 and {(r.key, r.first) for r in sample} <= {("x", 2), ("y", 3)}


def test_hll_registers_follow_the_bits(spark):
    values = [f"v{k}" for k in range(300)]
    want = {}
    for v in values:
        bits = bin(int(hashlib.sha256(v.encode()).hexdigest(), 16))[2:].zfill(256)
        rank = len(bits[12:]) - len(bits[12:].lstrip("0")) + 1
        reg = f"{int(bits[:12], 2):03x}"
        want[reg] = max(want.get(reg, 0), rank)
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.reg: r.rank for r in sketches.hll_registers(df, F.col("v")).collect()}
    assert got == want
    assert sketches.hll_estimate(sketches.hll_registers(df.limit(0), F.col("v"))).first()[0] == 0


@pytest.mark.parametrize("n", [1, 50, 4000, 30_000])
def test_hll_is_within_three_sigma_and_merges(spark, n):
    half = sketches.hll_registers(spark.range(n // 2 + 1), F.col("id"))
    whole = sketches.hll_registers(spark.range(n), F.col("id"))
    got = sketches.hll_estimate(sketches.hll_merge(half, whole)).first()[0]
    assert abs(got - n) <= max(1, 3 * 0.0163 * n)


def replay(groups, window):
    """The list replay by simulation: ones are pushed, the oldest popped while it is too old."""
    held = []
    for bits in groups:
        for k, bit in enumerate(bits):
            now = -(len(bits) - k)
            while held and now - held[0] > window:
                held.pop(0)
            if bit:
                held.append(now)
    return max(len(held) - 1, 0)


def lists(spark, groups):
    rows, k = [], 0
    for g, bits in enumerate(groups):
        for b in bits:
            rows.append((k, f"s{g}", "r", b))
            k += 1
    return spark.createDataFrame(rows, "id long, species string, role string, bit int")


@pytest.mark.parametrize(("groups", "want"), [([[1, 0, 1], [1]], 2), ([[1]], 0), ([[0]], 0), ([[1] * 400], 300), ([[1] * 400, [1] * 10], 310), ([[1] * 5 + [0] * 400, [1] * 310], 300)])
def test_dgim_replay_of_known_lists(spark, groups, want):
    assert replay(groups, 300) == want
    assert sketches.dgim_replay(lists(spark, groups), "bit").first()[0] == want


def test_dgim_replay_of_random_lists(spark):
    draw = random.Random(1)
    for _ in range(6):
        groups = [[int(draw.random() < draw.choice([0, 0.2, 0.9])) for _ in range(draw.randint(1, 30))] for _ in range(4)]
        assert sketches.dgim_replay(lists(spark, groups), "bit", 7).first()[0] == replay(groups, 7)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=300), st.integers(1, 120))
def test_dgim_counter_is_within_half(bits, window):
    counter = sketches.Dgim(window)
    for t, bit in enumerate(bits):
        counter.add(bit, t)
    exact = sum(b for t, b in enumerate(bits) if len(bits) - 1 - t <= window)
    assert abs(counter.estimate() - exact) <= 0.5 * exact + 1
    sizes = [s for _, s in counter.buckets]
    assert sizes == sorted(sizes) and all(sizes.count(s) <= 2 for s in sizes)


def test_dgim_estimate_is_the_counters(spark):
    draw = random.Random(2)
    start = datetime(2024, 1, 1)
    rows, counters = [], {}
    for t in range(700):
        g = draw.choice(["a", "b"])
        bit = int(draw.random() < 0.6)
        rows.append((t, g, "r", bit, start + timedelta(seconds=t)))
        counters.setdefault(g, sketches.Dgim(200)).add(bit, t)
    got = {r.species: r.estimate for r in sketches.dgim_estimate(spark.createDataFrame(rows, "id long, species string, role string, bit int, ts timestamp"), "bit", 200, start + timedelta(seconds=699)).collect()}
    assert got == {g: c.estimate(699) for g, c in counters.items()}


def test_murmur3_of_published_values(spark):
    assert murmur3_32(b"", 0) == 0 and murmur3_32(b"", 1) == 0x514E28B7 and murmur3_32(b"test", 0) == 0xBA6BD213 and murmur3_32(b"Hello, world!", 0x9747B28C) == 0x24884CBA
    assert spark.range(1).select(murmur3(F.lit("test"), F.lit(0))).first()[0] == 0xBA6BD213 - (1 << 32)


def test_murmur3_of_arrays_is_that_of_each_text(spark):
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(4)
    texts = ["".join(map(chr, draw.integers(1, 0x2FF, n))) for n in draw.integers(0, 30, 400)] + ["x" * 4096, "y" * 4097, "", None, "🐝" * 9]
    seeds = draw.integers(0, 2**32, len(texts))
    for low, high in ((0, len(texts)), (7, 40), (3, 3)):
        got = murmur3_array(pa.array(texts).slice(low, high - low), seeds[low:high])
        assert got.tolist() == [murmur3_32((t or "").encode(), int(s)) for t, s in zip(texts[low:high], seeds[low:high], strict=True)]
    rows = spark.createDataFrame([("a", 1), (None, 1), ("a", None), ("a", -1)], "x string, s int").select(murmur3("x", "s").alias("h")).collect()
    assert [r.h is None for r in rows] == [False, True, True, False] and rows[0].h != rows[3].h
