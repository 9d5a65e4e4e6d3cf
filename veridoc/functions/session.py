"""Cutting lineage without local copies, and keys that may be unknown."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """The folder every executor can reach. Only a local session may go without: its executors are this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None and spark.sparkContext.master.split("[")[0] == "local":
        where = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    if where is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where.rstrip("/")


def drop_on_exit(spark, path: str) -> str:
    """`path`, which goes when the session's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept as a table in the shared folder; its plan starts there, with the table's true size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(drop_on_exit(spark, path))


class Appended:
    """A table in the shared folder to which each round of a loop adds its own rows; rows that are there are never written again."""

    def __init__(self, spark, schema: str):
        self.spark, self.schema, self.rounds = spark, schema, 0
        self.path = drop_on_exit(spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}")

    def add(self, rows: DataFrame) -> DataFrame:
        """The rows of this round, as written."""
        at = f"{self.path}/round={self.rounds}"
        rows.write.option("compression", "zstd").parquet(at)
        self.rounds += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def read(self) -> DataFrame:
        """The rows of all rounds."""
        rounds = [f"{self.path}/round={n}" for n in range(self.rounds)]
        return self.spark.read.schema(self.schema).parquet(*rounds)


def known(col: str) -> Column:
    """Whether a key is there: neither null nor the empty text."""
    return F.col(col).isNotNull() & (F.col(col).cast("string") != "")


def by_known(key: str, order: Sequence[str]) -> list[Column]:
    """What to partition a window of a key by: rows without one, of which there may be many, go anywhere. Nothing may be read from their windows."""
    return [F.col(key), F.when(known(key), F.lit(None)).otherwise(F.xxhash64(*order))]
