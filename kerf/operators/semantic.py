"""Chunks at semantic boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerf.operators import analytics, sentences


def groups(docs: DataFrame, embed, window: int = 3, threshold: float = 0.3) -> DataFrame:
    """(doc_id, group, text, byte_start): sentences joined up to each boundary, larger and smaller ones alike."""
    rows = sentences.sentences(docs)
    cuts = analytics.semantic_boundaries(rows, embed, window=window, threshold=threshold).where("is_boundary").select("doc_id", "pos", F.lit(1).alias("cut"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    number = F.coalesce(F.sum(F.coalesce("cut", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(cuts, ["doc_id", "pos"], "left").withColumn("group", number)
    item = F.struct("pos", "sentence")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["sentence"]), "")
    return rows.groupBy("doc_id", "group").agg(text.alias("text"), F.min("byte_start").alias("byte_start"))


def halves(text: Column, max_size: int) -> Column:
    """A text's sentences packed to a size; sentences that are larger are cut by characters."""
    cut = F.flatten(F.transform(sentences.split(text), lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / max_size).cast("int")), lambda k: F.substr(s, k * max_size + 1, F.lit(max_size)))))
    return sentences.pack(cut, max_size)


def semantic_chunks(docs: DataFrame, embed, max_size: int = 1500, window: int = 3, threshold: float = 0.3) -> DataFrame:
    """Chunk rows of documents cut at semantic boundaries; none is larger than ``max_size`` characters."""
    item = F.struct("group", "text")
    packed = groups(docs, embed, window, threshold).groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("g"))
    pieces = F.flatten(F.transform("g", lambda x: halves(x["text"], max_size)))
    return sentences.chunk_rows(packed, pieces)
