"""Sharding by size-tiered compaction, with DataFrame functions only.

Method: each arrival is written as small immutable shards (Parquet files of a new folder) and added to the manifest.
Shards are in tiers by size: tier k holds those of target / fan_in^k bytes or less and more than the next tier's. When a
tier below the target holds fan_in shards or more, they are merged into files of about the target size. Every change is a
new manifest, a table of its own, and becomes a version by one small file that is created without overwriting: a version
exists whole or not at all, the second of two writers that follow the same version gets an error and has changed nothing,
and readers of older versions are not disturbed until vacuum() removes what only they use.

Merged rows are dealt by a hash of the file and the row's number in it, so no key can overload a shard, and a lost task
deals them alike when it runs again. A manifest has one row per shard, about one per target_bytes of data; the driver
reads the paths of one version.

Edge cases: empty arrivals add a version without shards; reading a store without shards gives an empty table of the
store's schema. Null values and extra columns are stored as they are; columns are matched by name, and an arrival whose
columns differ from the store's is refused.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.sources.commits import Commits

TARGET_BYTES = 128 << 20
FAN_IN = 4
MANIFEST = "path string, rows long, bytes long, tier int"


class ShardStore:
    """A folder with shards/ (immutable files), manifests/ (a table per change) and versions/ (a file per version)."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.folder, self.schema, self.target, self.fan_in = spark, folder, schema, target_bytes, fan_in
        self.versions = Commits(spark, f"{folder}/versions")

    # --- versions

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return self.versions.newest()

    def manifest(self, version: int | None = None) -> DataFrame:
        """Shards of a version: path, rows, bytes, tier."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/{self.versions.text(version)}")

    def commit(self, shards: DataFrame, after: int) -> int:
        """Make shards the version that follows `after`; an error if somebody else has made that version."""
        name = uuid.uuid4().hex
        shards.select("path", "rows", "bytes", "tier").coalesce(1).write.parquet(f"{self.folder}/manifests/{name}")
        return self.versions.add(name, after)

    # --- writing

    def _tier(self):
        size = F.greatest(F.col("bytes"), F.lit(1)).cast("double")
        down = F.floor(F.log(F.lit(float(self.target)) / size) / F.lit(math.log(self.fan_in)))
        return F.greatest(down, F.lit(0)).cast("int")

    def _written(self, rows: DataFrame) -> DataFrame:
        """Write rows to a new folder; the manifest rows of its files, sizes from the file system and counts from them."""
        folder = f"{self.folder}/shards/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        files = self.spark.read.format("binaryFile").load(f"{folder}/*.parquet").select("path", F.col("length").alias("bytes"))
        counts = self.spark.read.schema(self.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
        clean = F.regexp_replace("path", "^file:/+", "file:/")
        listed = files.withColumn("path", clean).join(counts.withColumn("path", clean), "path")
        return listed.select("path", "rows", "bytes", self._tier().alias("tier"))

    def append(self, arrival: DataFrame) -> int:
        """Add an arrival's rows as shards, one for each task that has rows; returns the version."""
        if sorted(arrival.columns) != sorted(self.schema.names):
            raise ValueError(f"columns {arrival.columns} are not the store's {self.schema.names}")
        version = self.version()
        new = self._written(arrival.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]))
        return self.commit(self.manifest(version).unionByName(new), version)

    def compact(self) -> int:
        """Merge tiers that are due until none is; returns the newest version."""
        while True:
            version = self.version()
            shards = self.manifest(version)
            tiers = shards.where("tier > 0").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
            due = tiers.where(F.col("n") >= self.fan_in).orderBy(F.desc("tier")).first()
            if due is None:
                return version
            paths = [r.path for r in shards.where(F.col("tier") == due.tier).select("path").collect()]
            files = max(1, round(due.bytes / self.target))
            rows = self.spark.read.schema(self.schema).parquet(*paths)
            dealt = rows.repartition(files, F.xxhash64("_metadata.file_path", "_metadata.row_index")) if files > 1 else rows.coalesce(1)
            merged = self._written(dealt.select(*self.schema.names))
            self.commit(shards.where(F.col("tier") != due.tier).unionByName(merged), version)
            if files >= due.n:
                return version + 1

    def vacuum(self, older_than: float = 86_400) -> None:
        """Remove shards and manifests that the newest version does not use, if they are older than so many seconds: longer
        than a writer takes from its first shard to its commit, and than readers keep an older version."""
        version = self.version()
        used = {r.folder for r in self.manifest(version).select(F.regexp_extract("path", r"/shards/([^/]+)/", 1).alias("folder")).distinct().collect()}
        used |= {self.versions.text(version)} if version else set()
        for kind in ("shards", "manifests"):
            root = self.versions.path(f"{self.folder}/{kind}")
            for status in self.versions.fs.listStatus(root) if self.versions.fs.exists(root) else ():
                age = time.time() - status.getModificationTime() / 1000
                if status.getPath().getName() not in used and age >= older_than:
                    self.versions.fs.delete(status.getPath(), True)
        self.versions.remove_stale(older_than, keep=version)

    # --- reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        paths = [r.path for r in self.manifest(version).select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)
