"""A table of records by key that is merged when it is read: changes cost what they change, not the table.

Records lie in base folders, parted by a hash of their key into buckets. An upsert or a deletion writes a small delta
folder and then a new manifest; a manifest names the folders of one snapshot, and readers take the newest one that was
written to its end. A write that fails leaves the last snapshot as it was. Compaction rewrites the buckets that deltas
touch, and no others. Snapshots stay readable until `vacuum`. One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MANIFEST = "folder string, kind string, seq long, bucket int"


@dataclass(frozen=True)
class RecordLog:
    """Records of a schema (DDL) below a location that driver and executors share."""

    spark: SparkSession
    location: str
    schema: str
    key: str = "path"
    buckets: int = BUCKETS

    # ---- snapshots

    def _files(self, pattern: str) -> list[str]:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{pattern}")
        found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path)
        return [status.getPath().toString() for status in found or []]

    def versions(self) -> list[int]:
        """The snapshots that were written to their end, in order."""
        return sorted(int(name.split("/")[-2]) for name in self._files("manifests/*/_SUCCESS"))

    def _manifest(self, version: int | None) -> list:
        known = self.versions()
        if not known:
            return []
        at = known[-1] if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.location}/manifests/{at:012d}").collect()  # a few rows a folder

    def _commit(self, rows: list[tuple]) -> int:
        version = (self.versions() or [0])[-1] + 1
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.location}/manifests/{version:012d}")
        return version

    # ---- writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _write(self, rows: DataFrame, kind: str) -> str:
        folder = f"data/{kind}-{uuid.uuid4().hex}"
        rows.write.partitionBy("bucket").parquet(f"{self.location}/{folder}")
        return folder

    def _append(self, rows: DataFrame) -> int:
        old = [tuple(r) for r in self._manifest(None)]
        folder = self._write(rows.select("*", self._bucket()), "delta")
        seq = max([r[2] for r in old], default=0) + 1
        return self._commit([*old, (folder, "delta", seq, None)])

    def upsert(self, records: DataFrame) -> int:
        """Records take the place of those of their key; of several of one key the greatest counts. Returns the version."""
        record = F.struct(*[F.col(c) for c in self._columns() if c != self.key])
        one = records.groupBy(self.key).agg(F.max(record).alias("r")).select(self.key, "r.*")
        return self._append(one.select(*self._columns(), F.lit(False).alias("deleted")))

    def delete(self, keys: DataFrame) -> int:
        gone = keys.select(F.col(self.key)).distinct()
        columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema if f.name != self.key]
        return self._append(gone.select(self.key, *columns, F.lit(True).alias("deleted")))

    def clear(self) -> int:
        """An empty snapshot; nothing is rewritten."""
        return self._commit([])

    # ---- reading

    def _newest(self, manifest: list) -> DataFrame | None:
        """The last record or tombstone of each key that a delta names."""
        parts = None
        for row in manifest:
            if row.kind == "delta":
                part = self.spark.read.schema(f"{self.schema}, deleted boolean, bucket int").parquet(f"{self.location}/{row.folder}").withColumn("seq", F.lit(row.seq))
                parts = part if parts is None else parts.unionByName(part)
        if parts is None:
            return None
        record = F.struct(*[F.col(c) for c in (*self._columns(), "deleted", "bucket") if c != self.key])
        return parts.groupBy(self.key).agg(F.max_by(record, "seq").alias("r")).select(self.key, "r.*")

    def _base(self, manifest: list) -> DataFrame:
        """What the base folders hold; of a folder only the buckets that the snapshot takes from it are read."""
        by_folder: dict[str, list[int]] = {}
        for row in manifest:
            if row.kind == "base":
                by_folder.setdefault(row.folder, []).append(row.bucket)
        out = self.spark.createDataFrame([], f"{self.schema}, bucket int")
        for folder, buckets in by_folder.items():
            part = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.location}/{folder}")
            out = out.unionByName(part.where(F.col("bucket").isin(buckets)))
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The records of a snapshot, the newest one by default. Only the deltas are grouped; the base is filtered by their keys."""
        manifest = self._manifest(version)
        base, newest = self._base(manifest), self._newest(manifest)
        if newest is None:
            return base.select(*self._columns())
        kept = base.join(newest.select(self.key), self.key, "left_anti")
        return kept.select(*self._columns()).unionByName(newest.where(~F.col("deleted")).select(*self._columns()))

    # ---- upkeep

    def compact(self) -> int:
        """Fold the deltas into the buckets that they touch; the others stay where they are."""
        manifest = self._manifest(None)
        newest = self._newest(manifest)
        if newest is None:
            return (self.versions() or [0])[-1]
        touched = {r.bucket for r in newest.select("bucket").distinct().collect()}  # BUCKETS at most
        kept = self._base([r for r in manifest if r.kind == "base" and r.bucket in touched]).join(newest.select(self.key), self.key, "left_anti")
        merged = kept.select(*self._columns(), "bucket").unionByName(newest.where(~F.col("deleted")).select(*self._columns(), "bucket"))
        folder = self._write(merged.repartition("bucket"), "base")
        seq = max(r.seq for r in manifest)
        rest = [tuple(r) for r in manifest if r.kind == "base" and r.bucket not in touched]
        return self._commit([*rest, *((folder, "base", seq, bucket) for bucket in sorted(touched))])

    def vacuum(self) -> int:
        """Delete the folders and manifests that the newest snapshot does not need; returns the number of folders deleted."""
        keep = {r.folder.rpartition("/")[2] for r in self._manifest(None)}
        known = self.versions()
        old = [name for name in self._files("data/*") if name.rpartition("/")[2] not in keep]
        old += [name for name in self._files("manifests/*") if known and int(name.rpartition("/")[2]) != known[-1]]
        context = self.spark.sparkContext
        for name in old:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        return len(old)
