"""An incremental store of chunks: two Parquet tables, written as snapshots that a pointer names.

A sync compares a listing with the files that the last snapshot holds, cuts new and changed files only and writes
the next snapshot; the pointer moves last, so a reader or a crash never sees half of one.  A file that fails keeps
no chunks, is listed with its error and is tried again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerf.functions import sizing
from kerf.operators import analytics
from kerf.operators.chunking import chunk
from kerf.plans.options import CHUNK_SCHEMA

_FILES = "path string, modified timestamp, size bigint, content_sha string, error string"


class Store:
    """Chunks of files under ``location``, any folder that Spark can write."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.location)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _current(self) -> str | None:
        fs, path = self._fs()
        pointer = path(f"{self.location}/CURRENT")
        return self.spark.read.text(f"{self.location}/CURRENT").first()[0] if fs.exists(pointer) else None

    def _publish(self, name: str) -> None:
        fs, path = self._fs()
        temporary = path(f"{self.location}/_next-{name}")
        out = fs.create(temporary, True)
        out.write(bytearray(name.encode()))
        out.close()
        # One rename that replaces what is there, so there is a pointer at all times.
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(temporary), fs.makeQualified(path(f"{self.location}/CURRENT")), options)

    def files(self) -> DataFrame:
        current = self._current()
        return self.spark.read.parquet(f"{self.location}/{current}/files") if current else self.spark.createDataFrame([], _FILES)

    def chunks(self) -> DataFrame:
        current = self._current()
        return self.spark.read.parquet(f"{self.location}/{current}/chunks") if current else self.spark.createDataFrame([], CHUNK_SCHEMA + ", stable_id string")

    def query(self, path: str) -> DataFrame:
        """The chunks of one file, in order."""
        return self.chunks().where(F.col("filepath") == path).orderBy("index")

    def sync(self, documents: DataFrame, **options) -> dict:
        """Brings the store to ``documents`` (doc_id, path, content, modified, size); returns counts.

        A file's SHA-256 decides whether it is the one of the snapshot, whatever its time and size.
        """
        old_files, old_chunks = self.files(), self.chunks()
        listing = documents.select("doc_id", "path", "content", "modified", "size")
        known = old_files.where("error is null").select("path", F.col("content_sha").alias("c"))
        rows = listing.join(known, "path", "left")
        sha = F.sha2(F.col("content").cast("binary"), 256)
        rows = rows.withColumn("sha", sha).withColumn("unchanged", F.coalesce(F.col("sha") == F.col("c"), F.lit(False)))
        name = f"snapshot-{uuid.uuid4().hex}"
        at = f"{self.location}/{name}"
        fresh = chunk(rows.where(~F.col("unchanged")).select("doc_id", "path", "content"), **options)
        fresh = fresh.withColumn("stable_id", F.when(F.col("error").isNull(), sizing.stable_id("filepath", "index", "byte_start", "byte_end")))
        fresh.write.parquet(f"{at}/fresh")
        fresh = self.spark.read.parquet(f"{at}/fresh")
        errors = fresh.where("error is not null").select(F.col("filepath").alias("path"), F.col("error").alias("error")).dropDuplicates(["path"])
        rows.select("path", "modified", "size", F.col("sha").alias("content_sha")).join(errors, "path", "left").write.parquet(f"{at}/files")
        kept = old_chunks.join(rows.where("unchanged").select(F.col("path").alias("filepath")), "filepath", "left_semi")
        kept.unionByName(fresh.where("error is null")).write.parquet(f"{at}/chunks")
        new_files = self.spark.read.parquet(f"{at}/files")
        counts = {
            "indexed": rows.where(~F.col("unchanged")).count(), "skipped": rows.where("unchanged").count(), "failed": new_files.where("error is not null").count(),
            "deleted": old_files.join(new_files, "path", "left_anti").count(),
        }
        status = analytics.diff(old_chunks, self.spark.read.parquet(f"{at}/chunks")).groupBy("status").count().collect()
        counts |= {"added": 0, "removed": 0, "unchanged": 0} | {r["status"]: r["count"] for r in status}
        self._publish(name)
        return counts
