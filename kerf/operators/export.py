"""Rows for vector stores and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerf.functions import sizing

META = ("text", "section_type", "index", "filepath", "language", "total_chunks", "content_type", "nws_count", "char_count", "token_count", "line_start", "line_end", "byte_start", "byte_end")


def with_stable_id(chunks: DataFrame) -> DataFrame:
    return chunks if "stable_id" in chunks.columns else chunks.withColumn("stable_id", sizing.stable_id("filepath", "index", "byte_start", "byte_end"))


def metadata(chunks: DataFrame) -> Column:
    """The flat fields of a chunk, as a map of strings; fields that the rows lack are left out."""
    return F.map_from_entries(F.array(*(F.struct(F.lit(c), F.col(c).cast("string")) for c in META if c in chunks.columns)))


def _joined(chunks: DataFrame, vectors: DataFrame, key: str, check: bool) -> DataFrame:
    chunks = with_stable_id(chunks)
    if check and (chunks.select(key).exceptAll(vectors.select(key)).limit(1).count() or vectors.select(key).exceptAll(chunks.select(key)).limit(1).count()):
        raise ValueError("chunks and embeddings don't have the same keys")
    return chunks.join(vectors.select(key, "embedding"), key)


def pinecone(chunks: DataFrame, vectors: DataFrame, key: str = "stable_id", namespace: str | None = None, check: bool = True) -> DataFrame:
    """(id, values, metadata[, namespace]); ``vectors`` has (key, embedding), and with ``check`` the same keys."""
    rows = _joined(chunks, vectors, key, check)
    out = rows.select(F.col("stable_id").alias("id"), F.col("embedding").alias("values"), metadata(rows).alias("metadata"))
    return out.withColumn("namespace", F.lit(namespace)) if namespace else out


def weaviate(chunks: DataFrame, vectors: DataFrame, class_name: str = "Chunk", key: str = "stable_id", check: bool = True) -> DataFrame:
    rows = _joined(chunks, vectors, key, check)
    return rows.select(F.lit(class_name).alias("class"), F.col("embedding").alias("vector"), metadata(rows).alias("properties"))


def supabase(chunks: DataFrame, vectors: DataFrame, key: str = "stable_id", check: bool = True) -> DataFrame:
    rows = _joined(chunks, vectors, key, check)
    return rows.select("stable_id", F.col("text").alias("content"), "embedding", *(c for c in META if c in rows.columns and c != "text"))


def framework_documents(chunks: DataFrame, content: str = "page_content") -> DataFrame:
    """(id, content, metadata): what document classes of retrieval frameworks are made of."""
    rows = with_stable_id(chunks)
    return rows.select(F.col("stable_id").alias("id"), F.col("text").alias(content), metadata(rows).alias("metadata"))


def flat(chunks: DataFrame) -> DataFrame:
    """The 17 columns of CSV files."""
    rows = with_stable_id(chunks)
    return rows.select("stable_id", *META, F.array_join("breadcrumb", " > ").alias("breadcrumb"), F.size("entities").alias("entity_count"))


#: Every text comes back as it was: white space at its ends, carriage returns and the character that Spark would take for an escape of quotes' escapes.
_CSV = {"header": True, "escape": '"', "charToEscapeQuoteEscaping": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(chunks).write.mode(mode).options(**_CSV).csv(path)


def read_csv(spark, path: str) -> DataFrame:
    """The rows of ``write_csv``, all columns texts."""
    return spark.read.options(**_CSV, multiLine=True).csv(path)


def write_jsonl(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    chunks.write.mode(mode).json(path)


def read_jsonl(spark, path: str) -> DataFrame:
    """Chunks with all nested fields, as ``write_jsonl`` wrote them."""
    from kerf.plans.options import CHUNK_SCHEMA

    return spark.read.schema(CHUNK_SCHEMA).json(path)
