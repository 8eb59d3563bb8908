"""Operators from chunks to chunks and from chunks to figures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType, _parse_datatype_string
from pyspark.sql.window import Window

from kerf.functions import sizing
from kerf.kernels import signatures
from kerf.kernels import tfidf as tfidf_kernel
from kerf.operators import sentences as sentence_ops
from kerf.plans.session import checkpoint

# statistics and quality:


def chunk_stats(chunks: DataFrame, by: tuple[str, ...] = (), size: str = "char_count") -> DataFrame:
    """Count, mean, least and largest size, in all or by columns; an empty input has a count of 0."""
    figures = [F.count("*").alias("total_chunks"), F.round(F.avg(size), 4).alias("avg_size"), F.min(size).alias("min_size"), F.max(size).alias("max_size")]
    return chunks.groupBy(*by).agg(*figures) if by else chunks.agg(*figures)


def entity_distribution(chunks: DataFrame) -> DataFrame:
    """(type, n) of the chunks' entities."""
    return chunks.select(F.explode("entities").alias("e")).groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"))


def size_balance(n: Column, smallest: int, largest: int) -> Column:
    """1 in the middle of the range, falling to 0 at its ends."""
    middle, half = (smallest + largest) / 2, (largest - smallest) / 2
    if half <= 0:
        return F.when(n == smallest, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(n - F.lit(middle)) / F.lit(half))


def quality_scores(chunks: DataFrame, min_size: int, max_size: int, size: str = "char_count") -> DataFrame:
    """Adds integrity, scope_consistency, size_balance and overall; ``entities`` has structs of is_partial and parent."""
    total = F.size("entities")
    partial = F.size(F.filter("entities", lambda e: e["is_partial"]))
    integrity = F.when(total > 0, 1 - partial / total).otherwise(F.lit(1.0))
    labels = F.size(F.array_distinct(F.transform("entities", lambda e: F.coalesce(e["parent"], e["name"]))))
    scope = F.when(labels <= 1, F.lit(1.0)).when(labels == 2, F.lit(0.75)).otherwise(F.greatest(F.lit(0.0), F.lit(0.75) - F.lit(0.22) * (labels - 2)))
    out = chunks.withColumn("integrity", integrity).withColumn("scope_consistency", scope).withColumn("size_balance", size_balance(F.col(size), min_size, max_size))
    overall = F.lit(0.45) * F.col("integrity") + F.lit(0.30) * F.col("scope_consistency") + F.lit(0.25) * F.col("size_balance")
    return out.withColumn("overall", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), overall)), 4))


# evaluation:


def reconstruction(source: Column, text: Column, start: Column, end: Column) -> Column:
    """1 where the source's bytes of the range are the text's, null without a source."""
    same = F.substring(source.cast("binary"), start + 1, end - start) == text.cast("binary")
    return F.when(source.isNull(), None).otherwise(same.cast("double"))


def density(text: Column) -> Column:
    """Non-white-space bytes a character."""
    n = F.length(text)
    return F.when(n > 0, sizing.nws_bytes(text) / n).otherwise(F.lit(0.0))


def coverage(text: Column, source: Column) -> Column:
    """The part of a chunk's different terms that its source has; 1 for a chunk without terms."""
    own = F.array_distinct(sizing.terms(text))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, sizing.terms(source))) / F.size(own)).otherwise(F.lit(1.0))


def coverage_by(chunks: DataFrame, sources: DataFrame, keys: list[str], text: str = "text", source: str = "text") -> DataFrame:
    """(keys, coverage) of chunks by the terms of all ``sources`` together: terms are joined, so sources of any size will do."""
    rows = chunks.select(*keys, F.array_distinct(sizing.terms(text)).alias("own"))
    theirs = sources.select(F.explode(sizing.terms(source)).alias("term")).distinct().withColumn("known", F.lit(1))
    single = rows.select(*keys, F.explode_outer("own").alias("term")).join(theirs, "term", "left")
    part = F.when(F.count("term") > 0, F.count("known") / F.count("term")).otherwise(F.lit(1.0))
    return single.groupBy(*keys).agg(part.alias("coverage"))


def tfidf(texts: DataFrame, group: list[str], item: str, text: str = "text", max_vocab: int = 4096) -> DataFrame:
    """(group, item, term, w): L2-normalised TF-IDF within each group of texts, on its most frequent terms."""
    counted = texts.select(*group, item, F.explode(sizing.terms(text)).alias("term")).groupBy(*group, item, "term").agg(F.count("*").alias("tf"))
    sizes = texts.groupBy(*group).agg(F.countDistinct(item).alias("n_items"))
    df = counted.groupBy(*group, "term").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("df"), "term"))
    vocabulary = df.withColumn("r", rank).where(F.col("r") <= max_vocab).drop("r")
    rows = counted.join(vocabulary, [*group, "term"]).join(sizes, group)
    weight = (1 + F.log("tf")) * (F.log((1 + F.col("n_items")) / (1 + F.col("df"))) + 1)
    rows = rows.withColumn("raw", weight)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*group, item)))
    return rows.select(*group, item, "term", (F.col("raw") / norm).alias("w"))


def _pass(docs: DataFrame, key: str, pieces: Column, columns: str, found, positions: Column | None = None) -> DataFrame:
    """Rows of (key, columns) that ``found`` makes of a run of lists: (list, *columns), without a shuffle; places become ``positions``."""
    rows = docs.select(key, pieces.alias("l"), *([positions.alias("p")] if positions is not None else []))
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {columns}"
    arrow, placed = to_arrow_schema(_parse_datatype_string(schema)), positions is not None

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            for a, b in tfidf_kernel.slices(lists):
                which, place, *rest = found(lists.slice(a, b - a))
                at = pa.array(place, pa.int32())
                if placed:
                    given, offsets = signatures.flat(batch.column(2).slice(a, b - a))
                    at = given.take(pa.array(offsets[which] + place))
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([batch.column(0).take(pa.array(a + which)), at, *map(pa.array, rest)], arrow.types)], schema=arrow)

    return rows.mapInArrow(run, schema)


def tfidf_lists(docs: DataFrame, pieces: Column, key: str = "doc_id", max_vocab: int = 4096) -> DataFrame:
    """(key, pos, term, w): ``tfidf`` of groups that are lists of texts, one a row."""

    def found(lists):
        items, offsets = signatures.flat(lists)
        groups = np.repeat(np.arange(len(lists)), np.diff(offsets))
        item, term, w, different = tfidf_kernel.weights(items, groups, max_vocab)
        return groups[item], item - offsets[:-1][groups[item]], different.take(pa.array(term)), w

    return _pass(docs, key, pieces, "pos int, term string, w double", found)


def adjacent_similarity(texts: DataFrame, group: list[str], pos: str, text: str = "text") -> DataFrame:
    """(group, pos, similarity) of each item with the next one of its group, by TF-IDF cosines."""
    w = tfidf(texts, group, pos, text)
    after = w.select(*group, (F.col(pos) - 1).alias(pos), "term", F.col("w").alias("v"))
    near = w.join(after, [*group, pos, "term"]).groupBy(*group, pos).agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    base = texts.select(*group, pos, F.lead(pos).over(Window.partitionBy(*group).orderBy(pos)).alias("next")).where("next is not null").drop("next")
    return base.join(near, [*group, pos], "left").select(*group, pos, F.coalesce("s", F.lit(0.0)).alias("similarity"))


_coherence = arrow_udf(tfidf_kernel.coherence, DoubleType())
_first_similarity = arrow_udf(tfidf_kernel.first_similarity, DoubleType())
_of_source = arrow_udf(tfidf_kernel.of_source, ArrayType(StructType([StructField("reconstruction", DoubleType()), StructField("coverage", DoubleType())])))


def coherence(chunks: DataFrame, key: str = "stable_id") -> DataFrame:
    """(key, coherence): the mean similarity of a chunk's neighbouring sentences, 1 with fewer than two."""
    return chunks.select(key, _coherence(sentence_ops.split("text")).alias("coherence"))


def _boundary(before: Column, own: Column) -> Column:
    """1 less the similarity of a text's first two sentences and ``before``, null where that is; both are weighed as two texts."""
    head = F.concat_ws("", F.slice(own, 1, 2))
    return F.when(before.isNotNull(), 1 - _first_similarity(F.array(F.coalesce(before, F.lit("")), head)))


def _last_two(pieces: Column) -> Column:
    return F.when(pieces.isNotNull(), F.concat_ws("", F.slice(pieces, F.greatest(F.size(pieces) - 1, F.lit(1)), 2)))


def boundary_quality(chunks: DataFrame, doc: str = "doc_id", key: str = "stable_id") -> DataFrame:
    """(key, boundary_quality): 1 less the similarity of the two sentences on either side of a chunk's start; null for the first.

    Chunks that have the text ``before`` them stay where they are; of others the last two sentences are shuffled, never a term.
    """
    pieces = sentence_ops.split("text")
    if "before" in chunks.columns:
        return chunks.select(key, _boundary(_last_two(sentence_ops.split("before")), pieces).alias("boundary_quality"))
    ends = chunks.select(key, doc, "index", pieces.alias("s")).select(key, doc, "index", F.slice("s", 1, 2).alias("head"), _last_two(F.col("s")).alias("tail"))
    ends = ends.withColumn("before", F.lag("tail").over(Window.partitionBy(doc).orderBy("index")))
    return ends.select(key, _boundary(F.col("before"), F.col("head")).alias("boundary_quality"))


def evaluate(chunks: DataFrame, sources: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """Adds reconstruction, density, coverage, coherence and boundary_quality to chunks; ``sources`` has (doc, content)."""
    item = F.struct("index", *(c for c in chunks.columns if c not in (doc, "index")))
    # Chunks may hold maps, which have no order: they are sorted by their index alone.
    lists = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(item), lambda x, y: F.coalesce(x["index"] - y["index"], F.lit(0))).alias("chunks"))
    lists = lists.join(sources.select(doc, "content"), doc, "left") if sources is not None else lists.withColumn("content", F.lit(None).cast("string"))
    return evaluate_lists(lists, doc).select(*chunks.columns, "reconstruction", "density", "coverage", "coherence", "boundary_quality")


def evaluate_lists(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, fields of chunks, scores) of (doc, content, chunks), the chunks of a document an array in their order: nothing is shuffled."""

    def field(name: str) -> Column:
        return F.transform("chunks", lambda c: c[name])

    rows = docs.select(doc, "chunks", _of_source("content", field("text"), field("byte_start"), field("byte_end")).alias("__s"))
    rows = sentence_ops.rows_of(rows, F.col("chunks"), "__i", "__c")
    rows = rows.select(doc, "__c.*", F.get("__s", F.col("__i")).alias("__s"), F.get("chunks", F.col("__i") - 1)["text"].alias("__before"))
    rows = rows.withColumn("__p", sentence_ops.split("text")).withColumn("__b", _last_two(sentence_ops.split("__before")))
    rows = rows.withColumns({"reconstruction": F.col("__s.reconstruction"), "density": density(F.col("text")), "coverage": F.col("__s.coverage"), "coherence": _coherence("__p"), "boundary_quality": _boundary(F.col("__b"), F.col("__p"))})
    return rows.drop("__s", "__before", "__p", "__b")


def evaluation_report(scores: DataFrame) -> DataFrame:
    return scores.agg(*(F.avg(c).alias(c) for c in ("coverage", "coherence", "density", "reconstruction", "boundary_quality")))


# differences:


def diff(before: DataFrame, after: DataFrame, key: str = "stable_id", mode: str = "range") -> DataFrame:
    """(key, status): added, removed or unchanged, by one full outer join of different keys.

    ``mode`` content compares what chunks say instead of where they are: the key is then ``content_sha``, the SHA-256 of path and text.
    """
    if mode == "content":
        sha = F.sha2(F.concat_ws("\0", "filepath", "text").cast("binary"), 256)
        key, before, after = "content_sha", before.withColumn("content_sha", sha), after.withColumn("content_sha", sha)
    elif mode != "range":
        raise ValueError("a mode is range or content")
    a, b = before.select(key).distinct().withColumn("old", F.lit(True)), after.select(key).distinct().withColumn("new", F.lit(True))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


# hierarchy and overlap:


def group_consecutive(sizes: Column, limit: int) -> Column:
    """For each size of an array the number of its group: consecutive items while they fit; a larger one stands alone."""
    start = F.struct(F.lit(0).alias("g"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc, s):
        s = F.greatest(s.cast("bigint"), F.lit(1).cast("bigint"))
        opens = (acc["n"] > 0) & (acc["n"] + s > limit)
        g = acc["g"] + F.when(opens, 1).otherwise(0)
        return F.struct(g.alias("g"), F.when(opens, s).otherwise(acc["n"] + s).alias("n"), F.array_append(acc["out"], g).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def _parent_of(below: Column, groups: Column):
    """A function from a group's number to the node over its members."""

    def parent(g):
        mine = F.filter(below, lambda x, i: F.get(groups, i) == g)
        first, last = F.get(mine, F.lit(0)), F.element_at(mine, -1)
        total = F.aggregate(mine, F.lit(0).cast("bigint"), lambda s, x: s + F.greatest(x["size"], F.lit(0).cast("bigint")))
        return F.struct(g.alias("index"), first["byte_start"].alias("byte_start"), last["byte_end"].alias("byte_end"), total.alias("size"), first["index"].alias("child_start"), last["index"].alias("child_end"))

    return parent


def hierarchy(chunks: DataFrame, levels: list[int], doc: str = "doc_id", size: str = "char_count") -> DataFrame:
    """(doc, level, index, byte_start, byte_end, size, child_start, child_end): leaves at level 0, then a level for each larger size."""
    if not levels or any(b <= a for a, b in zip(levels, levels[1:])) or levels[0] <= 0:
        raise ValueError("levels are positive and grow")
    node = chunks.select(doc, F.lit(0).alias("level"), "index", "byte_start", "byte_end", F.col(size).cast("bigint").alias("size"), F.lit(None).cast("int").alias("child_start"), F.lit(None).cast("int").alias("child_end"))
    # A document's nodes are one sorted array, so each further level is a fold and not another shuffle.
    item = F.struct("index", "byte_start", "byte_end", "size", "child_start", "child_end")
    docs = node.groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("l0"))
    for k, limit in enumerate(levels[1:], 1):
        below = F.col(f"l{k - 1}")
        groups = group_consecutive(F.transform(below, lambda x: x["size"]), limit)
        docs = docs.withColumn(f"g{k}", groups)

        docs = docs.withColumn(f"l{k}", F.transform(F.array_distinct(f"g{k}"), _parent_of(below, F.col(f"g{k}"))))
    def at_level(k):
        return F.transform(f"l{k}", lambda x: F.struct(F.lit(k).alias("level"), x.alias("n")))

    every = F.concat(*map(at_level, range(len(levels))))
    return sentence_ops.rows_of(docs.select(doc, every.alias("__l")), F.col("__l"), "__i", "x").select(doc, "x.level", "x.n.*")


def parents(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, level, index, parent) of the nodes of ``hierarchy``; a root's parent is null."""
    above = nodes.where("child_start is not null").select(doc, (F.col("level") - 1).alias("level"), F.col("index").alias("parent"), F.explode(F.sequence("child_start", "child_end")).alias("index"))
    return nodes.select(doc, "level", "index").join(above, [doc, "level", "index"], "left").select(doc, "level", "index", "parent")


def children(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, level, index, children): the indices, in order, of the nodes below each that has some."""
    return nodes.where("child_start is not null").select(doc, "level", "index", F.sequence("child_start", "child_end").alias("children"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("level = 0")


def roots(nodes: DataFrame) -> DataFrame:
    """The nodes of the coarsest level."""
    return nodes.join(F.broadcast(nodes.agg(F.max("level").alias("level"))), "level").select(*nodes.columns)


def merged_context(nodes: DataFrame, chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, level, index, breadcrumb, entities): what the leaves of each node have, in order; of entities of one name and type the last."""
    inside = nodes.select(doc, "level", F.col("index").alias("node"), "byte_start", "byte_end")
    leaf = chunks.select(F.col(doc).alias("__d"), F.col("index").alias("__i"), F.col("byte_start").alias("__a"), F.col("byte_end").alias("__b"), "breadcrumb", "entities")
    rows = inside.join(leaf, (F.col(doc) == F.col("__d")) & (F.col("__a") >= F.col("byte_start")) & (F.col("__b") <= F.col("byte_end")))
    packed = rows.groupBy(doc, "level", "node").agg(F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), F.col("breadcrumb").alias("c"), F.col("entities").alias("e")))).alias("l"))
    crumbs, every = F.flatten(F.transform("l", lambda x: x["c"])), F.flatten(F.transform("l", lambda x: x["e"]))
    out = packed.select(doc, "level", F.col("node").alias("index"), crumbs.alias("breadcrumb"), every.alias("e"))
    last = F.filter("e", lambda x, i: ~F.exists(F.slice("e", i + 2, F.size("e")), lambda y: (y["name"] == x["name"]) & (y["type"] == x["type"])))
    return out.select(doc, "level", "index", "breadcrumb", last.alias("entities"))


def overlap_size(overlap: float | int, limit: int) -> int:
    """A part of the limit if it is under 1, else a size."""
    return int(limit * overlap) if isinstance(overlap, float) and overlap < 1 else int(overlap)


def overlap_groups(chunks: DataFrame, limit: int, overlap: float | int, doc: str = "doc_id") -> DataFrame:
    """(doc, index, byte_start, byte_end, text): sliding groups of full chunks; an overlap of 0 or less changes nothing."""
    shared = overlap_size(overlap, limit)
    if shared <= 0:
        return chunks.select(doc, "index", "byte_start", "byte_end", "text")
    unit = max(1, min(shared, limit - shared))
    stride, width = max(1, (limit - shared) // unit), max(1, limit // unit)
    groups = F.sequence(F.floor(F.greatest(F.lit(0), F.col("index") - width + stride) / stride).cast("int"), F.floor(F.col("index") / stride).cast("int"))
    rows = chunks.select(doc, "index", "byte_start", "byte_end", "text", F.explode(groups).alias("g")).where(F.col("g") * stride + width > F.col("index"))
    item = F.struct("index", "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "")
    return rows.groupBy(doc, F.col("g").alias("index")).agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), text.alias("text"))


def line_overlap(chunks: DataFrame, n_lines: int, doc: str = "doc_id") -> DataFrame:
    """Adds ``overlap_text``: the last lines, not blank, of the chunk before."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    last = F.array_join(F.slice(lines, F.greatest(F.size(lines) - n_lines + 1, F.lit(1)), max(n_lines, 1)), "\n")
    before = F.lag(last).over(Window.partitionBy(doc).orderBy("index"))
    return chunks.withColumn("overlap_text", before if n_lines > 0 else F.lit(None).cast("string"))


# graphs:


def graph_nodes(mentions: DataFrame, min_chunks: int = 2, key: str = "key", graph: tuple[str, ...] = ()) -> DataFrame:
    """(graph, name, n_chunks) of entities that so many chunks mention; ``mentions`` has (key, name) and the columns of ``graph``.

    There is one graph for each value of ``graph``, most often a document, or a single one.
    """
    return mentions.select(*graph, key, "name").distinct().groupBy(*graph, "name").agg(F.count("*").alias("n_chunks")).where(F.col("n_chunks") >= min_chunks)


def graph_edges(mentions: DataFrame, min_chunks: int = 2, key: str = "key", graph: tuple[str, ...] = ()) -> DataFrame:
    """(graph, a, b, shared, n_shared, weight), a < b: chunks of a graph that share nodes, with the Jaccard index of all their names.

    Overlaps are counted by the join itself: pairs of chunks meet once for each shared name, and set sizes come from
    two small aggregates, so no array of names is carried through that shuffle.  A name in n chunks of one graph gives n²/2 pairs,
    so corpora are graphs of documents (``graph``), whose chunks are few.
    """
    rows = mentions.select(*graph, F.col(key).alias("k"), "name").distinct()
    sizes = rows.groupBy(*graph, "k").agg(F.count("*").alias("n"))
    common = rows.join(graph_nodes(rows, min_chunks, "k", graph).drop("n_chunks"), [*graph, "name"]).select(*graph, "name", "k")
    linked = common.withColumnRenamed("k", "a").join(common.withColumnRenamed("k", "b"), [*graph, "name"]).where("a < b")
    linked = linked.groupBy(*graph, "a", "b").agg(F.array_sort(F.collect_list("name")).alias("shared"))
    out = linked.join(sizes.select(*graph, F.col("k").alias("a"), F.col("n").alias("na")), [*graph, "a"]).join(sizes.select(*graph, F.col("k").alias("b"), F.col("n").alias("nb")), [*graph, "b"])
    # Names of one chunk only can't be shared, so shared nodes are all that chunks share if two chunks make a node.
    n = F.size("shared").cast("bigint")
    return out.select(*graph, "a", "b", "shared", n.alias("n_shared"), (n / (F.col("na") + F.col("nb") - n)).alias("weight"))


def entity_chunks(mentions: DataFrame, key: str = "key", graph: tuple[str, ...] = ()) -> DataFrame:
    """(graph, name, chunks): the sorted keys of the chunks that mention a name."""
    return mentions.groupBy(*graph, "name").agg(F.array_sort(F.collect_set(key)).alias("chunks"))


def chunk_neighbours(edges: DataFrame, graph: tuple[str, ...] = ()) -> DataFrame:
    """(graph, chunk, neighbours): the sorted keys of the chunks that an edge joins with each chunk that has one."""
    ends = edges.select(*graph, F.col("a").alias("chunk"), F.col("b").alias("other")).union(edges.select(*graph, F.col("b"), F.col("a")))
    return ends.groupBy(*graph, "chunk").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


# budgets:


def budget_greedy(items: DataFrame, budget: int, query: str = "query_id") -> DataFrame:
    """Adds ``selected``: by falling score (ties by ``pos``) what still fits; ``items`` has (query, pos, score, size)."""
    if budget <= 0:
        raise ValueError("a budget is positive")
    item = F.struct((-F.col("score")).alias("neg"), "pos", F.greatest(F.col("size"), F.lit(1)).cast("bigint").alias("size"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<pos:bigint,selected:boolean>>").alias("out"))

    def step(acc, x):
        fits = acc["used"] + x["size"] <= budget
        row = F.struct(x["pos"].cast("bigint").alias("pos"), fits.alias("selected"))
        return F.struct((acc["used"] + F.when(fits, x["size"]).otherwise(F.lit(0).cast("bigint"))).alias("used"), F.array_append(acc["out"], row).alias("out"))

    packed = items.groupBy(query).agg(F.array_sort(F.collect_list(item)).alias("l"))
    chosen = packed.select(query, F.aggregate("l", start, step, lambda acc: acc["out"]).alias("__l"))
    return sentence_ops.rows_of(chosen, F.col("__l"), "__i", "x").select(query, "x.pos", "x.selected")


def knapsack(scores: np.ndarray, sizes: np.ndarray, budget: int) -> np.ndarray:
    """Which items have the greatest score within the budget; of equal ones the least size."""
    sizes = np.maximum(np.asarray(sizes, np.int64), 1)
    best = np.zeros(budget + 1)
    took = np.zeros((len(sizes), budget + 1), bool)
    for i, (s, n) in enumerate(zip(scores, sizes)):
        if n > budget:
            continue
        with_it = best[: budget + 1 - n] + s
        took[i, n:] = with_it > best[n:] + 1e-12
        best[n:] = np.where(took[i, n:], with_it, best[n:])
    at = int(np.flatnonzero(best >= best.max() - 1e-12)[0])
    out = np.zeros(len(sizes), bool)
    for i in range(len(sizes) - 1, -1, -1):
        if took[i, at]:
            out[i] = True
            at -= int(sizes[i])
    return out


MAX_CELLS = 50_000_000


def budget_dp(items: DataFrame, budget: int, query: str = "query_id", max_cells: int = MAX_CELLS) -> DataFrame:
    """Adds ``selected`` by an exact knapsack for each query, and ``strategy``: dp, or greedy where items times budget are over ``max_cells``."""
    if budget <= 0:
        raise ValueError("a budget is positive")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        scores, sizes = table["score"].to_numpy(), table["size"].to_numpy()
        exact = len(scores) * budget <= max_cells
        if exact:
            chosen = knapsack(scores, sizes, budget)
        else:
            chosen, used = np.zeros(len(scores), bool), 0
            for i in np.argsort(-scores, kind="stable"):
                n = max(1, int(sizes[i]))
                if used + n <= budget:
                    chosen[i], used = True, used + n
        return pa.table({query: table[query], "pos": table["pos"], "selected": chosen, "strategy": ["dp" if exact else "greedy"] * len(chosen)})

    rows = items.select(F.col(query).cast("bigint").alias(query), F.col("pos").cast("bigint").alias("pos"), F.col("score").cast("double").alias("score"), F.col("size").cast("bigint").alias("size"))
    return rows.groupBy(query).applyInArrow(run, f"{query} bigint, pos bigint, selected boolean, strategy string")


def without_overlap(items: DataFrame, threshold: float = 0.85, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query, pos) of the items whose words aren't those of a better one that stays: by falling score, ties by ``pos``.

    Words are stretches without white space; two texts overlap from a Jaccard index of ``threshold``, two without words do.  A query's
    candidates are folded within one row, as they are what a search returned.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is over 0 and 1 at most")
    own = F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    item = F.struct((-F.col("score")).alias("neg"), F.col("pos").cast("bigint").alias("pos"), own.alias("w"))
    packed = items.groupBy(query).agg(F.array_sort(F.collect_list(item)).alias("l"))
    start = F.array().cast("array<struct<pos:bigint,w:array<string>>>")

    def overlaps(a, b):
        both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
        return (any_ == 0) | (both * 10_000 >= any_ * round(threshold * 10_000))

    def step(acc, x):
        return F.when(F.exists(acc, lambda k: overlaps(k["w"], x["w"])), acc).otherwise(F.array_append(acc, F.struct(x["pos"].alias("pos"), x["w"].alias("w"))))

    return packed.select(query, F.explode(F.aggregate("l", start, step)).alias("x")).select(query, "x.pos")


def budget_select(items: DataFrame, budget: int, strategy: str = "greedy", preserve_order: bool = True, deduplicate: bool = False, threshold: float = 0.85, query: str = "query_id") -> DataFrame:
    """(query, selected, dropped, total, budget, strategy) of (query, pos, score, size, and text to remove overlaps).

    ``selected`` has the positions in their order, or by falling score; ``dropped`` all others in order; ``total`` the selected sizes.
    """
    if strategy not in ("greedy", "dp"):
        raise ValueError("a strategy is greedy or dp")
    key = F.col("pos").cast("bigint")
    candidates = items.join(without_overlap(items, threshold, query).withColumnsRenamed({query: "__q", "pos": "__p"}), (F.col(query) == F.col("__q")) & (key == F.col("__p")), "left_semi") if deduplicate else items
    chosen = (budget_greedy if strategy == "greedy" else budget_dp)(candidates, budget, query).where("selected").select(F.col(query).alias("__q"), F.col("pos").alias("__p"), F.lit(True).alias("taken"))
    rows = items.join(chosen, (F.col(query) == F.col("__q")) & (key == F.col("__p")), "left")
    item = F.struct((F.lit(0.0) if preserve_order else -F.col("score")).alias("neg"), key.alias("pos"), F.coalesce("taken", F.lit(False)).alias("taken"), F.greatest(F.col("size"), F.lit(1)).cast("bigint").alias("size"))
    packed = rows.groupBy(query).agg(F.array_sort(F.collect_list(item)).alias("l"))
    mine = F.filter("l", lambda x: x["taken"])
    total = F.aggregate(mine, F.lit(0).cast("bigint"), lambda s, x: s + x["size"])
    others = F.array_sort(F.transform(F.filter("l", lambda x: ~x["taken"]), lambda x: x["pos"]))
    return packed.select(query, F.transform(mine, lambda x: x["pos"]).alias("selected"), others.alias("dropped"), total.alias("total"), F.lit(budget).alias("budget"), F.lit(strategy).alias("strategy"))


# semantics:


def semantic_boundaries(sentences: DataFrame, embed, doc: str = "doc_id", window: int = 3, threshold: float = 0.3) -> DataFrame:
    """(doc, pos, similarity, is_boundary): similarity of a sentence's surroundings with the next one's; a boundary is a
    low one or a strict local minimum. ``embed`` makes an array column of a text column."""
    order = Window.partitionBy(doc).orderBy("pos")
    half = window // 2
    around = F.array_join(F.collect_list("sentence").over(order.rowsBetween(-half, half)), "")
    rows = sentences.select(doc, "pos", embed(around).alias("e"))
    rows = rows.select(doc, "pos", sizing.cosine("e", F.lead("e").over(order)).alias("similarity"), F.lead("pos").over(order).alias("next")).where("next is not null").drop("next")
    before, after = F.lag("similarity").over(order), F.lead("similarity").over(order)
    valley = (F.col("similarity") < before) & (F.col("similarity") < after)
    return rows.select(doc, "pos", "similarity", ((F.col("similarity") < threshold) | F.coalesce(valley, F.lit(False))).alias("is_boundary"))


def embedding_similarity(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of each vector with the next, in order of keys; a vector whose next one is null has no row.

    The order runs through the whole table, so neighbours meet within partitions of a range sort; the first and the last row of each
    partition are kept beside the similarities and meet afterwards.  The sort is run once, as a second run may part the keys otherwise.
    """
    rows = embeddings.select(key, vector).repartitionByRange(key).sortWithinPartitions(key, vector)
    fields = [rows.schema[key], StructField("a", rows.schema[vector].dataType), StructField("b", rows.schema[vector].dataType), StructField("p", IntegerType()), StructField("edge", IntegerType())]
    schema = StructType([StructField(f.name, f.dataType) for f in fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        p, held = TaskContext.get().partitionId(), None

        def edge(row: pa.RecordBatch, which: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([row.column(0).cast(arrow.types[0]), row.column(1).cast(arrow.types[1]), pa.nulls(1, arrow.types[2]), pa.array([p], pa.int32()), pa.array([which], pa.int32())], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                yield edge(batch.slice(0, 1), 0)
            else:
                batch = pa.concat_batches([held, batch])
            n = batch.num_rows - 1
            own, after = batch.slice(0, n), batch.slice(1, n)
            if n:
                yield pa.RecordBatch.from_arrays([own.column(0).cast(arrow.types[0]), own.column(1).cast(arrow.types[1]), after.column(1).cast(arrow.types[2]), pa.array([p] * n, pa.int32()), pa.nulls(n, pa.int32())], schema=arrow)
            held = batch.slice(n, 1)
        if held is not None:
            yield edge(held, 1)

    found = rows.mapInArrow(run, schema)
    inside = F.col("edge").isNull()
    found = checkpoint(found.where(~inside | F.col("b").isNotNull()).select(key, "p", "edge", F.when(inside, sizing.cosine("a", "b")).alias("similarity"), F.when(~inside, F.col("a")).alias("a")))
    edges = found.where(~inside).withColumn("b", F.lead("a").over(Window.orderBy("p", "edge"))).where("edge = 1 and b is not null")
    return found.where(inside).select(key, "similarity").union(edges.select(key, sizing.cosine("a", "b").alias("similarity")))


def window_similarity(sentences: DataFrame, doc: str = "doc_id", window: int = 5, text: str = "sentence") -> DataFrame:
    """(doc, pos, similarity): TF-IDF cosine of the ``window`` sentences that end with ``pos`` and the ``window`` behind it.

    With two texts a term's weight is known from its counts alone: its inverse frequency is 1 in both and ln(3/2) + 1 in one.
    """
    lists = sentences.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("pos", F.col(text).alias("s")))).alias("l"))
    return window_similarity_lists(lists, F.transform("l", lambda x: x["s"]), doc, window, F.transform("l", lambda x: x["pos"].cast("int")))


def window_similarity_lists(docs: DataFrame, pieces: Column, doc: str = "doc_id", window: int = 5, positions: Column | None = None) -> DataFrame:
    """``window_similarity`` of documents whose sentences are one list."""
    return _pass(docs, doc, pieces, "pos int, similarity double", lambda lists: tfidf_kernel.windows(lists, window), positions)


def topic_shifts(similarity: DataFrame, doc: str = "doc_id", threshold: float = 0.5, gap: int = 3) -> DataFrame:
    """(doc, pos): positions of low similarity (of ``window_similarity``), each at least ``gap`` after the one before."""
    low = similarity.where(F.col("similarity") < threshold).groupBy(doc).agg(F.array_sort(F.collect_list("pos")).alias("l"))
    start = F.struct(F.lit(-(10**9)).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(acc, p):
        return F.when(p - acc["last"] >= gap, F.struct(p.alias("last"), F.array_append(acc["out"], p).alias("out"))).otherwise(acc)

    return sentence_ops.rows_of(low.select(doc, F.aggregate("l", start, step, lambda acc: acc["out"]).alias("__l")), F.col("__l"), "__i", "pos").select(doc, "pos")
