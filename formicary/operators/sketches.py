"""Bloom filter, MinHash, HyperLogLog and DGIM as mergeable DataFrames.

Sketches are long tables: set bits, minima by hash function, ranks by register, buckets by size. They
merge by distinct, min and max. Keys are made distinct before they are multiplied by hash functions.
"""

from __future__ import annotations

import math
from collections import deque
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formicary.functions.hashing import hash_value, hex_hash
from formicary.functions.ordering import quantile_bounds, range_number, with_rank
from formicary.operators.store import age_seconds

# --- Bloom filter -----------------------------------------------------------------------------


def bloom_size(n: int, p: float = 0.03) -> tuple[int, int]:
    """(bits, hash functions) for n keys and a false-positive rate p; (0, 0) for no keys."""
    if n < 1:
        return 0, 0
    bits = int(-n * math.log(p) / math.log(2) ** 2)
    return bits, int(bits / n * math.log(2))


def _spread(keys: DataFrame) -> DataFrame:
    """Distinct keys dealt over all tasks: few rows, but each is about to be hashed many times."""
    return keys.distinct().repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def key_of(*columns: str) -> Column:
    return F.concat_ws("_", *columns)


def bloom_positions(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(key, bit) for the distinct keys."""
    spread = _spread(keys.select(key)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))))
    return spread.select(key, (hash_value(F.col("_i"), F.col(key)) % bits).alias("bit"))


def bloom_build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """The filter's set bits; an empty filter (bits 0) has none."""
    if not bits:
        return keys.sparkSession.createDataFrame([], "bit long")
    return bloom_positions(keys, key, bits, hashes).select("bit").distinct()


def bloom_probe(probes: DataFrame, key: str, built: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(key, maybe): false means certainly absent. An empty filter answers false."""
    if not bits:
        return probes.select(key).distinct().withColumn("maybe", F.lit(False))
    marked = bloom_positions(probes, key, bits, hashes).join(built.withColumn("_set", F.lit(True)), "bit", "left")
    return marked.groupBy(key).agg(F.bool_and(F.coalesce("_set", F.lit(False))).alias("maybe"))


# --- MinHash ----------------------------------------------------------------------------------

HASHES = 128


def minhash(rows: DataFrame, sets: list[str], key: str, hashes: int = HASHES) -> DataFrame:
    """(sets..., i, min_hash) of each set's distinct keys, as eight hex digits."""
    spread = _spread(rows.select(*sets, key)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))))
    return spread.groupBy(*sets, "i").agg(F.min(hex_hash(F.col("i"), F.col(key))).alias("min_hash"))


def jaccard(one: DataFrame, two: DataFrame, hashes: int = HASHES) -> Column | DataFrame:
    """One row (jaccard): the share of equal minima of two signatures (i, min_hash).

    Two empty signatures are equal (1); an empty and another one differ (0).
    """
    both = one.select("i", F.col("min_hash").alias("_a")).join(two.select("i", F.col("min_hash").alias("_b")), "i", "full")
    counted = both.agg(F.count("*").alias("_n"), F.count_if(F.col("_a") == F.col("_b")).alias("_same"))
    return counted.select(F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.col("_same") / hashes).alias("jaccard"))


def pairwise_jaccard(signatures: DataFrame, name: str, hashes: int = HASHES) -> DataFrame:
    """(name_a, name_b, jaccard) for the named sets that agree anywhere, each pair once.

    Joined on equal minima, so only agreeing positions make rows.
    """
    a = signatures.select(F.col(name).alias(f"{name}_a"), "i", "min_hash")
    b = signatures.select(F.col(name).alias(f"{name}_b"), "i", "min_hash")
    met = a.join(b, ["i", "min_hash"]).filter(F.col(f"{name}_a") < F.col(f"{name}_b"))
    return met.groupBy(f"{name}_a", f"{name}_b").agg((F.count("*") / hashes).alias("jaccard"))


def representatives(rows: DataFrame, key: str, order: str, size: int, hashes: int = HASHES, seed: str = "sample") -> DataFrame:
    """(i, key, first): the key of least hash at `size` of the positions, with its first row.

    Positions are drawn by a hash of the seed, so one key may stand for several of them.
    """
    firsts = rows.groupBy(key).agg(F.min(order).alias("first"))
    spread = firsts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))))
    least = spread.groupBy("i").agg(F.min(F.struct(hex_hash(F.col("i"), F.col(key)).alias("h"), F.col("first").alias("first"), F.col(key).alias("key"))).alias("_m"))
    drawn = least.select("i", F.col("_m.key").alias(key), F.col("_m.first").alias("first"))
    return drawn.orderBy(hex_hash(F.col("i"), F.lit(seed)), "i").limit(size)


def redundancy(window: DataFrame, candidates: DataFrame, key: str, threshold: float = 0.5, hashes: int = HASHES) -> DataFrame:
    """(key, similarity, label): a candidate set of one key against the window's set; `redundant` or `new`."""
    have = minhash(window.withColumn("_set", F.lit(0)), ["_set"], key, hashes).select("i", "min_hash")
    asked = _spread(candidates.select(key)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1)))).withColumn("_h", hex_hash(F.col("i"), F.col(key)))
    met = asked.join(F.broadcast(have), "i", "left").groupBy(key).agg((F.count_if(F.col("_h") == F.col("min_hash")) / hashes).alias("similarity"))
    return met.withColumn("label", F.when(F.col("similarity") >= threshold, "redundant").otherwise("new"))


# --- HyperLogLog ------------------------------------------------------------------------------

REGISTERS = 4096


def hll_registers(rows: DataFrame, value: Column) -> DataFrame:
    """(reg, rank): by the first 12 bits of SHA-256, the longest run of zeros in the other 244, plus 1."""
    hashed = rows.select(F.sha2(value.cast("string"), 256).alias("_h")).filter("_h is not null")
    rest = hashed.select(F.substring("_h", 1, 3).alias("reg"), F.regexp_replace(F.expr("substring(_h, 4)"), "^0+", "").alias("_r"))
    first = F.conv(F.substring("_r", 1, 1), 16, 10).cast("int")
    zeros = F.when(first >= 8, 0).when(first >= 4, 1).when(first >= 2, 2).when(first >= 1, 3).otherwise(0)
    return rest.groupBy("reg").agg(F.max(4 * (61 - F.length("_r")) + zeros + 1).alias("rank"))


def hll_merge(*registers: DataFrame) -> DataFrame:
    out = registers[0]
    for more in registers[1:]:
        out = out.unionByName(more)
    return out.groupBy("reg").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame) -> DataFrame:
    """One row (estimate): the corrected harmonic mean, rounded half to even."""
    m = float(REGISTERS)
    sums = registers.agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("_s"), F.count("*").alias("_k"))
    empty = F.lit(REGISTERS) - F.col("_k")
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.coalesce("_s", F.lit(0.0)) + empty)
    two32 = 4294967296.0
    held = sums.select(raw.alias("_e"), empty.alias("_v"))
    out = F.when((F.col("_e") <= 2.5 * m) & (F.col("_v") > 0), m * F.ln(F.lit(m) / F.col("_v"))).when(F.col("_e") > two32 / 30, -two32 * F.ln(1 - F.col("_e") / two32)).otherwise(F.col("_e"))
    return held.select(F.bround(out).cast("long").alias("estimate"))


# --- DGIM -------------------------------------------------------------------------------------


class Dgim:
    """The published sliding-window counter: at most two buckets of a size, the two oldest merge."""

    def __init__(self, window: float, buckets: list[tuple[float, int]] | None = None) -> None:
        self.window = window
        self.buckets: deque[tuple[float, int]] = deque(buckets or [])  # newest first, (time of its latest one, size)

    def _expire(self, now: float) -> None:
        while self.buckets and now - self.buckets[-1][0] > self.window:
            self.buckets.pop()

    def add(self, bit: int, now: float) -> None:
        self._expire(now)
        if bit != 1:
            return
        held = [(now, 1), *self.buckets]
        size, at = 1, 0
        while True:
            same = [k for k in range(at, len(held)) if held[k][1] == size]
            if len(same) < 3:
                break
            held[same[1] : same[2] + 1] = [(held[same[1]][0], 2 * size)]
            at, size = same[1], 2 * size
        self.buckets = deque(held)

    def estimate(self, now: float | None = None) -> int:
        """Sizes of the buckets in the window, the oldest one's halved."""
        if now is not None:
            self._expire(now)
        if not self.buckets:
            return 0
        return int(sum(s for _, s in self.buckets) - self.buckets[-1][1] / 2)


def bit_of(event: str = "predator attack", column: str = "event") -> Column:
    return F.when(F.col(column) == event, 1).otherwise(0)


def dgim_replay(rows: DataFrame, bit: str, window: int = 300, keys: tuple[str, ...] = ("species", "role"), order: str = "id") -> DataFrame:
    """One row (estimate): the counter that replays each group's list as if one element came a second.

    Groups follow each other in order of their first row, and each list ends at the same moment. Only
    whole buckets of size 1 are kept, so a group drops its ones beyond the last window + 1 places until
    some one survives; it then shields all that follow. The last bucket counts half, rounded down.
    """
    micros = F.col(order).cast("long")
    ranks = with_rank(rows.select(*keys, order, bit), list(keys), [order], range_number(micros, quantile_bounds(rows, micros)), "_rank")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    marked = ranks.join(sizes, list(keys))
    groups = marked.groupBy(*keys, "_first").agg(F.sum(bit).alias("_all"), F.sum(F.when(F.col("_n") - F.col("_rank") <= window, F.col(bit)).otherwise(0)).alias("_late"))
    earlier = F.coalesce(F.sum("_late").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per group
    left = groups.select(F.when(earlier > 0, F.col("_all")).otherwise(F.col("_late")).alias("_left"))
    return left.agg(F.greatest(F.coalesce(F.sum("_left"), F.lit(0)) - 1, F.lit(0)).cast("long").alias("estimate"))


def dgim_estimate(rows: DataFrame, bit: str, seconds: float, now: datetime, keys: tuple[str, ...] = ("species", "role"), ts: str = "ts", order: str = "id") -> DataFrame:
    """(keys..., ones, estimate) by the published algorithm, without replaying it.

    What buckets n ones leave depends on n alone: the digits of n in base 2 with digits 1 and 2, newest
    first. So each group's bucket bounds are looked up by rank among its ones: ranks are found in time
    ranges, and only about 2*log2(n) rows per group meet.
    """
    ones = rows.filter(F.col(bit) == 1).select(*keys, ts, order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    ranked = with_rank(ones, list(keys), [ts, order], range_number(micros, quantile_bounds(ones, micros)), "_rank")
    totals = ones.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(age_seconds(F.lit(now), ts) <= seconds).alias("ones"))
    # digit k of n: 1 or 2 buckets of size 2**k; left is what the digits above stand for
    digits = F.aggregate(
        F.sequence(F.lit(0), F.lit(61)),
        F.struct(F.col("_n").alias("left"), F.lit(0).cast("long").alias("newer"), F.array().cast("array<struct<newer:bigint,size:bigint>>").alias("buckets")),
        lambda acc, k: F.when(acc["left"] <= 0, acc).otherwise(_digit(acc, k)),
    )
    buckets = totals.select(*keys, "_n", "ones", F.explode_outer(digits["buckets"]).alias("_b"))
    bounds = buckets.select(*keys, "ones", (F.col("_n") - F.col("_b.newer")).alias("_rank"), F.col("_b.size").alias("_size"))
    dated = bounds.join(ranked.select(*keys, "_rank", ts), [*keys, "_rank"])
    live = dated.filter(age_seconds(F.lit(now), ts) <= seconds)
    sums = live.groupBy(*keys).agg(F.sum("_size").alias("_s"), F.min_by("_size", "_rank").alias("_oldest"))
    out = totals.join(sums, list(keys), "left")
    return out.select(*keys, "ones", F.coalesce(F.floor(F.col("_s") - F.col("_oldest") / 2), F.lit(0)).cast("long").alias("estimate"))


def _digit(acc: Column, k: Column) -> Column:
    size = F.pow(F.lit(2.0), k).cast("long")
    digit = F.when(acc["left"] % 2 == 0, F.lit(2)).otherwise(F.lit(1)).cast("long")
    one = F.struct(acc["newer"].alias("newer"), size.alias("size"))
    two = F.struct((acc["newer"] + size).alias("newer"), size.alias("size"))
    added = F.when(digit == 2, F.array(one, two)).otherwise(F.array(one))
    return F.struct(((acc["left"] - digit) / 2).cast("long").alias("left"), (acc["newer"] + digit * size).alias("newer"), F.concat(acc["buckets"], added).alias("buckets"))
