"""Tables of iterative operators, in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset, which only a local master may leave it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and the executors of {master} share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="formicary-rounds-"))


class Scratch:
    """Written tables that cut the lineage of a loop: a lost executor costs a reread, not the rounds before.

    `keep` writes a table; `drop` deletes some that nothing reads any more. What is left goes when the driver's
    JVM ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at = spark, folder(spark)

    def _target(self, path: str):  # noqa: ANN202  Hadoop's file system and path
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/round-{uuid.uuid4().hex}"
        df.write.parquet(path)
        fs, target = self._target(path)
        fs.deleteOnExit(target)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            fs, target = self._target(df._scratch_path)
            fs.delete(target, True)
