"""Chunks of files as they arrive; the same stateless pass as in batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerf.operators import export
from kerf.operators.chunking import chunk


def read_stream(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """(doc_id, path, content) of new files under a directory."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def chunk_stream(documents: DataFrame, **options) -> DataFrame:
    """Chunk rows with ``total_chunks`` -1: a reader of a stream doesn't know what follows."""
    return chunk(documents, **options).withColumn("total_chunks", F.lit(-1))


def embed(chunks: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]], batch_size: int = 64) -> DataFrame:
    """(stable_id, embedding): texts are embedded in batches within each partition."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, batch_size):
                part = batch.slice(a, batch_size)
                vectors = embed_fn(part.column(1).to_pylist())
                if len(vectors) != part.num_rows:
                    raise ValueError("embed_fn gave a different number of vectors")
                yield pa.record_batch([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["stable_id", "embedding"])

    return export.with_stable_id(chunks).select("stable_id", "contextualized_text").mapInArrow(run, "stable_id string, embedding array<double>")


def upsert(stream: DataFrame, embed_fn, write: Callable[[DataFrame, int], None], checkpoint: str, batch_size: int = 64, adapter=export.pinecone, **trigger) -> StreamingQuery:
    """Writes vector rows of each micro-batch; ``write`` gets the rows and the batch's number and should be idempotent in it."""

    def each(batch: DataFrame, number: int) -> None:
        # Rows and their vectors come of one pass over the batch.
        rows = export.with_stable_id(batch.where("error is null")).persist()
        try:
            write(adapter(rows, embed(rows, embed_fn, batch_size), check=False), number)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def deduplicated(stream: DataFrame, time: str, delay: str = "1 hour", text: str = "text") -> DataFrame:
    """The first of equal texts within a watermark's delay."""
    return stream.withWatermark(time, delay).withColumn("content_sha", F.sha2(F.col(text).cast("binary"), 256)).dropDuplicatesWithinWatermark(["content_sha"])
