"""Sharding by size-tiered compaction.

A dataset is a folder of immutable Parquet files and a row of manifests, one for each version. Arrivals
are appended as small shards, as their tasks write them, without a shuffle. Compaction puts the live
shards into tiers by size, each `fanout` times the one before, and merges every tier that has gathered
enough shards, or a target-sized file's worth, into files of the target size; shards in a tier are alike in size, so
joining whole scan splits keeps the sizes even, and no row crosses the network. It goes on until no tier
is full, as in a log-structured store.

A version is a manifest (shard, bytes, rows, tier) written aside and renamed into place. The rename is
the commit, and fails where the place is taken. A writer makes version n + 1 from version n; where another
one was quicker, it makes its change again on what is there now: arrivals are added to it, and a compaction
whose shards another compaction has replaced gives its own files up. Readers take the highest version
there is; files that no version names are never read. Replaced shards stay until `vacuum`, which leaves
files alone that may belong to a writer about to commit.

Rows are kept as they are: null values, empty and very long texts and rows that repeat are rows like others.
Columns may have any names; all appends bring the same ones.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 64 << 20
#: Shards that fill a tier, which is also the step in size from tier to tier.
FANOUT = 4
#: Rows of an arriving shard at most; no row is left out, there are more shards.
ARRIVAL_ROWS = 1024
#: Sizes below this are one tier.
LEAST_BYTES = 64 << 10
#: Seconds for which files stay that no version names: longer than a writer takes from its first file to its commit.
GRACE_S = 86_400

MANIFEST = "shard string, bytes long, n_rows long, tier int"


class Conflict(Exception):
    """Shards to be replaced are no longer live."""


class ShardedDataset:
    """A sharded dataset under `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, least_bytes: int = LEAST_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.least_bytes = target_bytes, fanout, least_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version, the last by default."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{known[-1] if version is None else version:08d}")

    def read(self, version: int | None = None, *, schema=None) -> DataFrame:
        """The rows of a version. The list of its files is read by the driver; rows are not. Raises where nothing was ever appended."""
        files = [r["shard"] for r in self.manifest(version).select("shard").collect()]
        if not files and not self._fs.exists(self._path(f"{self.root}/data")):
            raise ValueError("the dataset has no rows yet")
        read = self.spark.read if schema is None else self.spark.read.schema(schema)
        return read.parquet(*[f"{self.root}/data/{f}" for f in files]) if files else read.parquet(f"{self.root}/data/*").limit(0)

    def append(self, rows: DataFrame, *, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Adds rows as small shards and commits. An arrival without rows adds a version with the same shards."""
        return self._commit(self._write(rows, arrival_rows))

    def compact(self) -> int:
        """Merges full tiers until there is none; each round is a version. The number of the last version."""
        while full := [r["tier"] for r in self._tiers().collect()]:
            live = self.manifest().filter(F.col("tier").isin(full)).select("shard", "bytes", "tier").orderBy("shard").collect()
            added = self.spark.createDataFrame([], MANIFEST)
            for tier in full:  # a handful: sizes grow by the fanout
                shards = [s for s in live if s["tier"] == tier]
                rows = self.spark.read.parquet(*[f"{self.root}/data/{s['shard']}" for s in shards])
                files = max(1, round(sum(s["bytes"] for s in shards) / self.target_bytes))
                added = added.unionByName(self._write(rows.coalesce(files), 0))
            try:
                self._commit(added, [s["shard"] for s in live])
            except Conflict:  # another compaction was quicker
                continue
        return self.versions()[-1] if self.versions() else 0

    def vacuum(self, *, older_than_s: float = GRACE_S) -> int:
        """Deletes files so old that the last version doesn't name, versions before it, and what failed commits left aside. The number of data files deleted."""
        keep = {r["shard"] for r in self.manifest().select("shard").collect()}
        before = (time.time() - older_than_s) * 1000
        listed = lambda folder: list(self._fs.listStatus(self._path(folder))) if self._fs.exists(self._path(folder)) else []
        files = [(f"{d.getPath().getName()}/{s.getPath().getName()}", s) for d in listed(f"{self.root}/data") for s in self._fs.listStatus(d.getPath())]
        dead = [s.getPath() for name, s in files if name.endswith(".parquet") and name not in keep and s.getModificationTime() <= before]
        for p in dead:
            self._fs.delete(p, False)
        for s in listed(f"{self.root}/aside"):
            if s.getModificationTime() <= before:
                self._fs.delete(s.getPath(), True)
        for v in self.versions()[:-1]:
            self._fs.delete(self._path(f"{self.root}/manifests/{v:08d}"), True)
        return len(dead)

    def _tier(self) -> Column:
        """0 up to least_bytes, then one more for each fanout; a shard from half the target on is in no tier (-1)."""
        steps = F.ceil(F.log(float(self.fanout), F.greatest(F.col("bytes"), F.lit(1)) / float(self.least_bytes)))
        return F.when(F.col("bytes") >= self.target_bytes / 2, F.lit(-1)).otherwise(F.greatest(F.lit(0), steps)).cast("int")

    def _tiers(self) -> DataFrame:
        sizes = self.manifest().filter("tier >= 0").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))
        return sizes.filter((F.col("n") >= self.fanout) | ((F.col("n") > 1) & (F.col("total") >= self.target_bytes))).select("tier").orderBy("tier")

    def _write(self, rows: DataFrame, arrival_rows: int) -> DataFrame:
        """Writes rows to new files; their part of a manifest, from what the files themselves say."""
        name = uuid.uuid4().hex
        path = f"{self.root}/data/{name}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", arrival_rows).parquet(path)
        told = self.spark.read.schema(rows.schema).parquet(path).select(F.concat(F.lit(f"{name}/"), F.col("_metadata.file_name")).alias("shard"), F.col("_metadata.file_size").alias("bytes"))
        return told.groupBy("shard", "bytes").agg(F.count("*").alias("n_rows")).withColumn("tier", self._tier())

    def _commit(self, added: DataFrame, removed: list[str] | None = None) -> int:
        """Makes the next version: the last one without the shards `removed` and with those `added`. Tried again while others are quicker."""
        spark, fs = self.spark, self.spark._jvm.org.apache.hadoop.fs
        files = fs.FileContext.getFileContext(self._path(self.root).toUri(), spark._jsc.hadoopConfiguration())
        never_over = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        gone = spark.createDataFrame([(s,) for s in removed or ()], "shard string")
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        while True:
            base = (self.versions() or [0])[-1]
            live = self.manifest(base) if base else spark.createDataFrame([], MANIFEST)
            if removed and live.join(gone, "shard", "left_semi").count() < len(removed):
                raise Conflict
            aside = f"{self.root}/aside/{uuid.uuid4().hex}"
            live.join(gone, "shard", "left_anti").unionByName(added).coalesce(1).write.parquet(aside)
            try:
                files.rename(self._path(aside), self._path(f"{self.root}/manifests/{base + 1:08d}"), never_over)
                return base + 1
            except Py4JJavaError as e:
                if not self._fs.exists(self._path(f"{self.root}/manifests/{base + 1:08d}")):
                    raise e


def placed(data: ShardedDataset, *, into: str = "placed") -> DataFrame:
    """Each row of the last version with the shard that holds it: (shard, bytes, tier, version) as one new column, which the rows mustn't have."""
    version = (data.versions() or [0])[-1]
    rows = data.read(version or None)
    if into.lower() in map(str.lower, rows.columns):
        raise ValueError(f"the rows have a column {into}; name another")
    at = F.concat_ws("/", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), F.col("_metadata.file_name"))
    known = data.manifest(version or None).select(F.col("shard").alias("_at"), F.struct("shard", "bytes", "tier", F.lit(version).alias("version")).alias("_to"))
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), at.alias("_at"))
    return rows.join(known, "_at").select("_row.*", F.col("_to").alias(into))
