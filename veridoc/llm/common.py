"""What the corpus operators share: reading tables, cutting lineage, ASCII folding."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch, the bytes but for a single longer row. Python workers hold one batch, so this bounds their memory.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. Only a local session may go without: its executors are this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None and spark.sparkContext.master.split("[")[0] == "local":
        where = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    if where is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as a compressed table to the shared folder and read again; the table goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder; its plan starts there, with the table's true size.

    A checkpoint would keep the estimate of the plan before it, and in a loop of joins each estimate is a product of the last.
    """
    return scratch(df, "cut")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` doesn't have in any case, one for each of `names`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}" in taken:
            name = f"{name}_"
        out.append(f"_{name}")
    return out


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def once(col: Column) -> Column:
    """`col` as a generator of one row: its value is made once, where Catalyst would put the expression into every use of the column."""
    return F.explode(F.array(col))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else: `lower` would fold other alphabets too."""
    return F.translate(text, UPPER, UPPER.lower())
