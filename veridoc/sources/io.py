"""Reading raw corpora, logs, exports and reference specs; writing datasets, upserts and versioned artefacts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.functions.session import cut


def scan_raw_corpus(spark: SparkSession, path: str, *, glob: str = "*") -> DataFrame:
    """(path, modified, size, content, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("sha256"))


LOG_SCHEMA = "message_id bigint, sent_at string, verdict string, pdf struct<sha256: string, size: bigint>, messages array<struct<text: string>>, _corrupt string"


def scan_submission_logs(spark: SparkSession, path: str, *, schema: str = LOG_SCHEMA) -> DataFrame:
    """Submissions of JSON log files, one document a file. Malformed files, and rows without messages, without a file or with an unknown verdict, are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter(F.col("_corrupt").isNull() & (F.size("messages") > 0) & F.col("pdf").isNotNull() & (F.coalesce("verdict", F.lit("UNKNOWN")) != "UNKNOWN")).drop("_corrupt")


CHAT_SCHEMA = "messages array<struct<id: bigint, date: string, from: string, file: string, reply_to_message_id: bigint, text: string>>"


def scan_chat_export(spark: SparkSession, path: str) -> DataFrame:
    """A row for each message of chat exports: id, date, from, file, reply_to, text, is_upload."""
    messages = spark.read.schema(CHAT_SCHEMA).option("multiLine", True).json(path).select(F.explode("messages").alias("m")).select("m.*")
    return messages.withColumnRenamed("reply_to_message_id", "reply_to").withColumn("is_upload", F.col("file").isNotNull())


SPEC_SCHEMA = "bank string, channels map<string, map<string, array<double>>>, pools map<string, map<string, array<string>>>"


def scan_reference_specs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(envelopes, pools) of nested specs, one JSON object a file: bounds by channel and metric, values by channel and layer."""
    specs = spark.read.schema(SPEC_SCHEMA).option("multiLine", True).json(path)
    metrics = specs.select("bank", F.explode("channels").alias("channel", "_m")).select("bank", "channel", F.explode("_m").alias("metric", "_r"))
    envelopes = metrics.select("bank", F.when(F.col("channel") != "*", F.col("channel")).alias("channel"), "metric", F.get("_r", F.lit(0)).alias("lo"), F.get("_r", F.lit(1)).alias("hi"))
    layers = specs.select("bank", F.explode("pools").alias("channel", "_l")).select("bank", "channel", F.explode("_l").alias("layer", "_v"))
    return envelopes, layers.select("bank", "channel", "layer", F.explode("_v").alias("value"))


def sink_dataset(df: DataFrame, path: str, fmt: str) -> None:
    """Writes rows as json, csv (sorted columns, a header) or parquet."""
    if fmt == "csv":
        df.select(*sorted(df.columns)).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no sink for {fmt}")


def sink_csv_export(df: DataFrame, path: str) -> None:
    sink_dataset(df, path, "csv")


def sink_upsert(new: DataFrame, current: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The current rows with those of `new` in place of older ones of the same key; of equal order the new one counts."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


class UpsertTable:
    """A table of the newest row of each key, in which an upsert rewrites only the buckets that its rows fall into.

    Rows lie in buckets by a hash of their key. A version is a manifest, one JSON file that names the folder of each
    bucket; a new version takes over the folders of buckets that nothing touched. The manifest's name is made with a
    call that fails where it exists, which file systems of the HDFS kind do atomically; a writer that lost starts again from the version
    that won. The number of buckets is fixed when the table is made, and a manifest has an entry for each.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: str, *, buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path.rstrip("/"), schema, list(keys), order, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict]:
        """(number, manifest) of the last version; 0 before the first."""
        where = self._path(f"{self.path}/_versions")
        done = [int(s.getPath().getName()) for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        if not done:
            return 0, {"folders": {}, "batch": -1, "buckets": self.buckets}
        last = max(done)
        text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/_versions/{last}").collect())
        return last, json.loads(text)

    def _commit(self, number: int, manifest: dict) -> bool:
        try:
            out = self._fs.create(self._path(f"{self.path}/_versions/{number}"), False)
        except Exception:
            if self._fs.exists(self._path(f"{self.path}/_versions/{number}")):
                return False
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return True

    def read(self) -> DataFrame:
        """The rows of the last version."""
        return self._rows(self._manifest()[1]["folders"].values())

    def _rows(self, folders) -> DataFrame:
        folders = sorted(folders)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def upsert(self, new: DataFrame, *, batch: int | None = None) -> list[int]:
        """Merges `new` as `sink_upsert` does; the buckets that were rewritten. A stream's `batch` that is there already changes nothing."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        columns = self.spark.createDataFrame([], self.schema).columns
        new = cut(new.select(*columns).withColumn("_bucket", bucket))
        touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())  # a row for each bucket at most
        while True:
            number, manifest = self._manifest()
            if manifest["buckets"] != self.buckets:
                raise ValueError(f"the table has {manifest['buckets']} buckets")
            if not touched or (batch is not None and batch <= manifest["batch"]):
                return []
            current = self._rows(f for b, f in manifest["folders"].items() if int(b) in touched)
            merged = sink_upsert(new.drop("_bucket"), current, self.keys, self.order).withColumn("_bucket", bucket)
            where = f"{self.path}/rows-{uuid.uuid4().hex}"
            merged.repartition("_bucket").write.partitionBy("_bucket").parquet(where)
            folders = manifest["folders"] | {str(b): f"{where}/_bucket={b}" for b in touched}
            if self._commit(number + 1, {"folders": folders, "batch": manifest["batch"] if batch is None else batch, "buckets": self.buckets}):
                return touched

    def each_batch(self, batch: DataFrame, number: int) -> None:
        """For `foreachBatch`: a batch that runs again after a failure is merged once."""
        self.upsert(batch, batch=number)


def sink_versioned_artifacts(dfs: Mapping[str, DataFrame], path: str, version: str) -> DataFrame:
    """Writes each table below `path/version`, then the manifest (name, version, n_rows, content_hash), which is returned.

    A version whose manifest is there is complete. The hash is one of the sum of the rows' hashes
    and their number: it doesn't depend on their order, and tells how often a row repeats.
    """
    spark = next(iter(dfs.values())).sparkSession
    out = None
    for name, df in dfs.items():
        where = f"{path}/{version}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(where)
        rows = spark.read.schema(df.schema).parquet(where)
        one = rows.agg(F.lit(name).alias("name"), F.lit(version).alias("version"), F.count("*").alias("n_rows"), F.xxhash64(F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)")), F.count("*")).alias("content_hash"), F.lit(where).alias("place"))
        out = one if out is None else out.unionByName(one)
    out.coalesce(1).write.parquet(f"{path}/{version}/_manifest")  # fails where the version exists
    return spark.read.parquet(f"{path}/{version}/_manifest")
