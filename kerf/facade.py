"""The library's functions for single files and directories, on a session that is there or a local one.

Results are DataFrames; what one document holds is small enough to be collected.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerf.functions import sizing
from kerf.operators import analytics, export
from kerf.operators.chunking import chunk as chunk_documents
from kerf.plans.options import Options
from kerf.plans.session import local_session
from kerf.sources import files


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or local_session()


class Chunker:
    """Options that several calls share; a call may change them."""

    def __init__(self, spark: SparkSession | None = None, **options):
        Options.of(**options)
        self.spark, self.options = spark or _session(), options

    def chunk(self, path: str, content: str | bytes, **options) -> DataFrame:
        kind = "binary" if isinstance(content, bytes) else "string"
        docs = self.spark.createDataFrame([(0, path, content)], f"doc_id bigint, path string, content {kind}")
        return chunk_documents(docs, **self.options | options)

    def chunk_documents(self, docs: DataFrame, **options) -> DataFrame:
        """Chunk rows of (doc_id, path, content), as many as there are."""
        return chunk_documents(docs, **self.options | options)

    def chunk_file(self, path: str, encoding: str = "utf-8", **options) -> DataFrame:
        with open(path, "rb") as f:
            content = f.read()
        return self.chunk(path, content if path.lower().endswith(files.BYTES_ONLY) else content.decode(encoding), **options)

    def chunk_directory(self, root: str, encoding: str = "utf-8", exclude: tuple[str, ...] = (), glob: str = "**/*", include_hidden: bool = False, **options) -> DataFrame:
        if not os.path.isdir(root) and "://" not in root:
            raise NotADirectoryError(root)
        return files.chunk_directory(self.spark, root, None, encoding, exclude, glob, include_hidden, **self.options | options)

    def batch(self, items: list[dict], **options) -> DataFrame:
        return chunk_documents(files.batch(self.spark, items), **self.options | options)

    def hierarchical_chunk(self, path: str, content: str, levels: list[int], size_unit: str = "chars", **options) -> DataFrame:
        """Nodes of all levels, as ``analytics.hierarchy`` gives them; leaves are cut at the first level's size."""
        if len(levels) < 2:
            raise ValueError("a hierarchy has two levels at least")
        sizes = {"max_chunk_size": levels[0], "min_chunk_size": max(1, levels[0] // 4), "size_unit": size_unit}
        chunks = self.chunk(path, content, **options | sizes)
        return analytics.hierarchy(chunks, levels, size={"chars": "char_count", "tokens": "token_count", "nws": "nws_count"}[size_unit])

    def chunk_diff(self, path: str, new_content: str, previous: DataFrame, mode: str = "range", **options) -> DataFrame:
        """(stable_id or content_sha, status) of a new cutting against the rows of a former one."""
        return analytics.diff(export.with_stable_id(previous), export.with_stable_id(self.chunk(path, new_content, **options)), mode=mode)

    def chunk_stats(self, chunks: DataFrame, size_unit: str = "chars") -> DataFrame:
        return analytics.chunk_stats(chunks, size={"chars": "char_count", "tokens": "token_count", "nws": "nws_count"}[size_unit])


def chunk(path: str, content: str | bytes, **options) -> DataFrame:
    return Chunker(**options).chunk(path, content)


def chunk_file(path: str, encoding: str = "utf-8", **options) -> DataFrame:
    return Chunker(**options).chunk_file(path, encoding)


def chunk_directory(root: str, encoding: str = "utf-8", exclude: tuple[str, ...] = (), glob: str = "**/*", include_hidden: bool = False, **options) -> DataFrame:
    return Chunker(**options).chunk_directory(root, encoding, exclude, glob, include_hidden)


def hierarchical_chunk(path: str, content: str, levels: list[int], size_unit: str = "chars", **options) -> DataFrame:
    return Chunker(**options).hierarchical_chunk(path, content, levels, size_unit)


def chunk_diff(path: str, new_content: str, previous: DataFrame, mode: str = "range", **options) -> DataFrame:
    return Chunker(**options).chunk_diff(path, new_content, previous, mode)


def stable_chunk_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("stable_id", sizing.stable_id("filepath", "index", "byte_start", "byte_end"))


def build_chunk_graph(chunks: DataFrame, min_chunks: int = 2, graph: tuple[str, ...] = ("filepath",)) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the entities of chunk rows; one graph for each file."""
    mentions = chunks.select(*graph, F.col("index").alias("key"), F.explode("entities.name").alias("name"))
    return analytics.graph_nodes(mentions, min_chunks, graph=graph), analytics.graph_edges(mentions, min_chunks, graph=graph)
