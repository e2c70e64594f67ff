"""Shared storage, broadcast bounds and Arrow row access for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from formicary.shipping import ship

#: Rows that go to a Python worker at a time, at most.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Keys that `join_spread` broadcasts the rows of, at most, and rows that it looks for them in.
HOT_KEYS = 1000
HOT_SAMPLE = 200_000

_local_fallback: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests).

    With its scheme, so that Spark and other readers mean the same store by it. Only a local master may leave it
    unset: executors elsewhere would write to disks of their own, and the driver would read a part.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        target = spark._jvm.org.apache.hadoop.fs.Path(found)
        return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and the executors of {master} share")
    if "dir" not in _local_fallback:
        _local_fallback["dir"] = "file://" + tempfile.mkdtemp(prefix="formicary-")
    return _local_fallback["dir"]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/formicary-{tag}-{uuid.uuid4().hex}"


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete a path that was written, when it ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path and what is under it, now."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    It cuts the lineage: a lost executor costs a reread, and what two later jobs need is computed once.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    delete_on_exit(spark, path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def written() -> int:
    """How many tables `materialize` has written so far; what `settle` takes."""
    return len(_written)


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, df._written_at)
        _written[_written.index(df._written_at)] = ""


def settle(df: DataFrame, tag: str, since: int) -> DataFrame:
    """Materialize df, then delete all other tables written since `written()` was `since`: only df read them."""
    out = materialize(df, tag)
    for k in range(since, len(_written) - 1):
        if _written[k]:
            delete(df.sparkSession, _written[k])
            _written[k] = ""
    return out


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores after it as make it unlike the beginning of every column."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


def join_spread(left: DataFrame, right: DataFrame, key: str, values: list[str], hot: list | None = None) -> DataFrame:
    """left with the `values` of right's row of the same key, null where there is none; right has one row a key.

    Keys that hold a thousandth of left's rows or more are joined by broadcast, HOT_KEYS rows of right at most, and
    their rows and those without a key are dealt at random, so no key fills a task. hot: these keys if the caller
    knows them; otherwise a sample of HOT_SAMPLE rows tells them.
    """
    if hot is None:
        n = left.count()
        seen = left.select(key).filter(F.col(key).isNotNull())
        seen = seen.sample(HOT_SAMPLE / n, seed=1) if n > HOT_SAMPLE else seen
        hot = [r[0] for r in seen.groupBy(key).count().filter(F.col("count") >= max(50, min(n, HOT_SAMPLE) // HOT_KEYS)).orderBy(F.desc("count")).limit(HOT_KEYS).collect()]
    own = unused("__join", left.columns)  # the beginning of all names that are added on the way
    rest, deal, to, same = (f"{own}_{x}" for x in ("rest", "deal", "to", "key"))
    found = {v: f"{own}_r_{v}" for v in values}
    named = right.select(F.col(key).alias(same), *(F.col(v).alias(found[v]) for v in values))
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    out = left.withColumn(rest, F.when(~is_hot, F.col(key)))
    out = out.withColumn(deal, F.xxhash64(F.when(F.col(rest).isNull(), F.monotonically_increasing_id()), rest))
    named = named.withColumn(to, F.xxhash64(F.lit(None).cast("long"), same))  # the same for the rows that can meet
    out = out.join(named, (F.col(deal) == F.col(to)) & (F.col(rest) == F.col(same)), "left").drop(same, to, rest, deal)
    values_of = {v: F.col(c) for v, c in found.items()}
    if hot:
        few = right.filter(F.col(key).isin(hot)).select(F.col(key).alias(same), *(F.col(v).alias(f"{own}_h_{v}") for v in values))
        out = out.join(F.broadcast(few), F.col(key) == F.col(same), "left").drop(same)
        values_of = {v: F.coalesce(F.col(f"{own}_h_{v}"), c) for v, c in values_of.items()}
    return out.select(*left.columns, *(c.alias(v) for v, c in values_of.items()))


def draw(h: Column) -> Column:
    """A 64-bit hash as a number from 0 to 2**63 - 1."""
    return F.shiftrightunsigned(h, 1)


def draw_bound(share: float) -> int:
    """What a share of all draws is below; the whole hash counts, so no share is too small."""
    return min(int(share * (1 << 63)), (1 << 63) - 1)


def arrow_map(df: DataFrame, f: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow with this package at hand on the executors, in batches of at most BATCH_ROWS rows.

    Whole texts then don't pile up in a worker. Spark reads the size from the session when the plan runs; a smaller one that is set already stays.
    """
    spark = df.sparkSession
    ship(spark)
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, BATCH_ROWS)
    return df.mapInArrow(f, schema)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> pa.BinaryArray:
    """A string column as binary with 32-bit offsets, without a copy where Arrow has none to make."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary())


def byte_rows(column: pa.Array, step: int = 128) -> Iterator[bytes | None]:
    """The values of a string column as bytes, a few at a time."""
    column = as_bytes(column)
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    column = as_bytes(column)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offs[0] : offs[-1]], offs - offs[0]
