"""Files as documents."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BYTES_ONLY = ("pdf", "docx")


def _any(patterns, column: Column) -> Column:
    """Whether a relative path, or a name in it, matches one of some shell patterns."""
    if not patterns:
        return F.lit(False)
    joined = "|".join(f"(?:{re.sub(r'\\Z|\\z', '', fnmatch.translate(p))})" for p in patterns)
    return column.rlike(f"^(?:{joined})$") | F.exists(F.split(column, "/"), lambda x: x.rlike(f"^(?:{joined})$"))


def _shell(glob: str) -> str:
    """A shell pattern for whole relative paths: ** stands for any folders, also none, * and ? for signs of one name."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?|\[!?[^\]]+\])", glob.removeprefix("./")):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part.startswith("[") and part.endswith("]") else re.escape(part))
    return f"^{out}$"


def read_directory(spark: SparkSession, root: str, encoding: str = "utf-8", exclude: tuple[str, ...] = (), glob: str = "**/*", include_hidden: bool = False) -> DataFrame:
    """(doc_id, path, content, modified, size, error) of the files under a directory.

    Listing and reading are Spark's; excluded and hidden files are dropped by their names before a byte of them is read.
    ``doc_id`` is a hash of the path, so it doesn't depend on what else is there.  ``content`` holds bytes; a file that should be
    text in ``encoding`` and isn't has an error and no content.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob.rsplit("/", 1)[-1] or "*").load(root)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/{1,3}", "/"), f"^.*?{re.escape(base.strip('/'))}/", "")
    rows = rows.withColumn("path", relative).where(~_any(exclude, F.col("path"))).where(F.col("path").rlike(_shell(glob)))
    if not include_hidden:
        rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    binary = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*BYTES_ONLY)
    if encoding.lower().replace("-", "") == "utf8":
        ok, content = binary | F.is_valid_utf8(F.col("content").cast("string")), F.col("content")
    else:
        ok, content = F.lit(True), F.when(binary, F.col("content")).otherwise(F.encode(F.decode("content", encoding), "utf-8"))
    return rows.select(
        F.xxhash64("path").alias("doc_id"), "path", F.when(ok, content).alias("content"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"),
        F.when(~ok, F.lit("UnicodeDecodeError: not valid UTF-8")).alias("error"),
    )


def batch(spark: SparkSession, files: list[dict]) -> DataFrame:
    """Documents of dictionaries with ``filepath`` and ``code``, numbered in their order."""
    rows = [(i, f["filepath"], f["code"]) for i, f in enumerate(files)]
    return spark.createDataFrame(rows, "doc_id bigint, path string, content string")


def chunk_directory(spark: SparkSession, root: str, parsers: dict | None = None, encoding: str = "utf-8", exclude: tuple[str, ...] = (), glob: str = "**/*", include_hidden: bool = False, **options) -> DataFrame:
    """Chunk rows of a directory's files, with an error row for each file that can't be read or cut."""
    from kerf.operators.chunking import chunk

    files = read_directory(spark, root, encoding, exclude, glob, include_hidden)
    chunks = chunk(files.where("error is null"), parsers, **options)
    failed = files.where("error is not null").select("doc_id", F.col("path").alias("filepath"), "error")
    return chunks.unionByName(failed, allowMissingColumns=True)
