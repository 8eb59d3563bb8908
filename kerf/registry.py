"""The engine's own registered queries, each over whole tables, and the SQL that states their results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerf.functions import detect, sizing
from kerf.operators import analytics, chunking, dedup, export, markup, sentences
from kerf.operators import propositions as propositions_ops
from kerf.plans.session import checkpoint, shared_dir

PACK, SMALL = 512, 256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer pieces than there are cores is spread over them, which a table of many files never is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def _together(parts: DataFrame, by: str = "p_brand") -> DataFrame:
    """Parts, those of a brand together: a brand is one document, so as many tasks as there are cores get some, however small the rows are."""
    return parts.repartition(4 * parts.sparkSession.sparkContext.defaultParallelism, by)


def packed(docs: DataFrame, size: int = PACK, before: bool = False) -> DataFrame:
    """Chunk rows of sentences packed to a number of characters; empty texts have none."""
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return sentences.chunk_rows(docs, sentences.pack(sentences.split("text"), size), path=path, keep=("lang",), before=before)


def _chunks(spark: SparkSession, sf_dir: str, size: int = PACK) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), size)


def doc_sizes(spark, d):
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", sizing.n_chars(t).alias("chars"), sizing.n_bytes(t).alias("bytes"), sizing.nws_bytes(t).alias("nws_bytes"), sizing.nws_chars(t).alias("nws_chars"), sizing.n_words(t).alias("words"))


def detect_language(spark, d):
    docs = _table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), F.concat("source", F.lit("/"), "doc_id", F.element_at(F.array(*map(F.lit, (".md", ".py", ".json.txt", "", ".yaml", ".d.ts", ".unknown"))), (F.col("doc_id") % 7 + 1).cast("int"))).alias("path"), F.col("text").alias("content"))
    pages = _table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), F.lit("page").alias("path"), F.col("html").alias("content"))
    rows = docs.union(pages).withColumn("language", detect.language_column("path", "content"))
    return rows.select("key", "path", "language", detect.content_type_column("path", "content", "language").alias("content_type"))


def sentence_split(spark, d):
    rows = sentences.sentences(_table(spark, d, "documents"))
    return rows.select("doc_id", "pos", "sentence", "char_start", "byte_start")


def conversation_sentences(spark, d):
    rows = sentences.sentences(_table(spark, d, "conversations").withColumn("id", F.concat_ws("/", "conv_id", "turn")), "id")
    return rows.select("id", "pos", "sentence")


def sentence_pack(spark, d):
    return _chunks(spark, d).drop("lang", "stable_id")


def stable_ids(spark, d):
    return _chunks(spark, d).select("doc_id", "index", "stable_id")


def chunk_stats_by_lang(spark, d):
    return analytics.chunk_stats(_chunks(spark, d), ("lang",))


def chunk_quality(spark, d):
    none = F.array().cast("array<struct<name:string,parent:string,is_partial:boolean>>")
    scored = analytics.quality_scores(_chunks(spark, d).withColumn("entities", none), 50, PACK)
    return scored.select("doc_id", "index", F.round("size_balance", 6).alias("size_balance"), F.round("overall", 4).alias("overall"))


def dedup_exact(spark, d):
    return dedup.exact(_table(spark, d, "documents"))


def simhash_signature(spark, d):
    return dedup.simhash(_table(spark, d, "documents"))


def simhash_pairs(spark, d):
    """Each document's class of equal signatures, and how many other classes it is linked with."""
    signed = checkpoint(dedup.simhash(_table(spark, d, "documents")))
    return dedup.linked_classes(signed, "simhash", dedup.simhash_links(signed))


def simhash_dedup(spark, d):
    return dedup.dedup(_table(spark, d, "documents"), "simhash")


def minhash_signature(spark, d):
    rows = dedup.minhash(_table(spark, d, "documents"))
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


def minhash_pairs(spark, d):
    """Each document's class of equal word sets, and how many other classes it is linked with."""
    signed = dedup.minhash(_table(spark, d, "documents"))
    return dedup.classes(signed, "digest", dedup.minhash_edges(signed))


def minhash_dedup(spark, d):
    return dedup.dedup(_table(spark, d, "documents"), "minhash")


def chunk_diff(spark, d):
    return analytics.diff(_chunks(spark, d), _chunks(spark, d, SMALL))


def chunk_density(spark, d):
    return _chunks(spark, d).select("doc_id", "index", F.round(analytics.density(F.col("text")), 6).alias("density"))


def chunk_reconstruction(spark, d):
    chunks = _chunks(spark, d).join(_table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    ok = analytics.reconstruction(F.col("content"), F.col("text"), F.col("byte_start"), F.col("byte_end"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min(ok).alias("reconstruction"))


def chunk_coverage(spark, d):
    """The part of each chunk's terms that the benchmark, as one source, has."""
    rows = analytics.coverage_by(_chunks(spark, d), _table(spark, d, "benchmark"), ["doc_id", "index"])
    return rows.select("doc_id", "index", F.round("coverage", 6).alias("coverage"))


def chunk_coherence(spark, d):
    return analytics.coherence(_chunks(spark, d)).select("stable_id", F.round("coherence", 6).alias("coherence"))


def chunk_boundary_quality(spark, d):
    return analytics.boundary_quality(packed(_table(spark, d, "documents"), before=True)).select("stable_id", (F.round("boundary_quality", 6) + F.lit(0.0)).alias("boundary_quality"))


def sentence_tfidf(spark, d):
    rows = analytics.tfidf_lists(_table(spark, d, "documents"), sentences.split("text"))
    return rows.select("doc_id", "pos", "term", F.round("w", 6).alias("w"))


def semantic_boundaries(spark, d):
    rows = analytics.semantic_boundaries(sentences.sentences(_table(spark, d, "documents")), sizing.mock_embedding, threshold=0.9)
    return rows.select("doc_id", "pos", F.round("similarity", 6).alias("similarity"), "is_boundary")


def embedding_adjacent_cosine(spark, d):
    return analytics.embedding_similarity(_table(spark, d, "embeddings")).select("vec_id", F.round("similarity", 6).alias("similarity"))


def _with_vectors(spark, d):
    chunks = _chunks(spark, d, 4096).select(F.col("doc_id").alias("key"), "filepath", "index", "byte_start", "byte_end", "text", "stable_id")
    return chunks, _table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")


def vector_rows(spark, d):
    """Every chunk of the documents that have a vector, with it."""
    rows = export.pinecone(*_with_vectors(spark, d), "key", check=False)
    return rows.select("id", F.size("values").alias("n_values"), F.col("metadata")["filepath"].alias("filepath"), F.col("metadata")["index"].alias("index"), F.col("metadata")["byte_end"].alias("byte_end"), F.col("metadata")["text"].alias("text"))


def weaviate_rows(spark, d):
    rows = export.weaviate(*_with_vectors(spark, d), key="key", check=False)
    return rows.select("class", F.get("vector", F.lit(0)).cast("double").alias("v0"), F.to_json(F.struct(*(F.col("properties")[c].alias(c) for c in ("byte_end", "byte_start", "filepath", "index")))).alias("properties"), F.col("properties")["text"].alias("text"))


def supabase_rows(spark, d):
    rows = export.supabase(*_with_vectors(spark, d), "key", check=False)
    return rows.select("stable_id", "content", F.get("embedding", F.lit(63)).cast("double").alias("v63"), "index", "filepath", "byte_start", "byte_end")


def framework_rows(spark, d):
    rows = export.framework_documents(_chunks(spark, d))
    return rows.select("id", "page_content", F.col("metadata")["line_start"].alias("line_start"), F.col("metadata")["token_count"].alias("token_count"), F.col("metadata")["filepath"].alias("filepath"))


def _engine_rows(spark, d):
    docs = _table(spark, d, "documents").where("trim(text) <> ''").select("doc_id", F.concat(F.lit("doc/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return chunking.chunk(docs, max_chunk_size=10_000_000, size_unit="chars", context_mode="none")


def csv_round_trip(spark, d):
    """Chunks written as CSV and read again."""
    at = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    export.write_csv(_engine_rows(spark, d), at)
    rows = export.read_csv(spark, at)
    return rows.select("filepath", F.col("byte_end").cast("int").alias("byte_end"), F.col("entity_count").cast("int").alias("entity_count"), "section_type", F.md5(F.col("text").cast("binary")).alias("text"))


def jsonl_round_trip(spark, d):
    """Chunks written as JSON lines and read again, with their nested fields."""
    at = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    export.write_jsonl(_engine_rows(spark, d), at)
    return export.read_jsonl(spark, at).select("doc_id", "filepath", "language", "byte_end", F.size("entities").alias("n_entities"), F.size("format_metadata").alias("n_metadata"), "text", "contextualized_text")


def _mentions(spark, d):
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}+"), F.lit(0)))
    return _chunks(spark, d).select("doc_id", F.col("index").alias("key"), F.explode(names).alias("name"))


def graph_nodes(spark, d):
    """Names of any length that several chunks of a document have; a graph for each document."""
    return analytics.graph_nodes(_mentions(spark, d), graph=("doc_id",))


def graph_edges(spark, d):
    rows = analytics.graph_edges(_mentions(spark, d), graph=("doc_id",))
    return rows.select("doc_id", "a", "b", F.array_join("shared", " ").alias("shared"), "n_shared", F.round("weight", 6).alias("weight"))


def graph_entity_chunks(spark, d):
    rows = analytics.entity_chunks(_mentions(spark, d), graph=("doc_id",))
    return rows.select("doc_id", "name", F.array_join(F.col("chunks").cast("array<string>"), ",").alias("chunks"))


def graph_neighbours(spark, d):
    rows = analytics.chunk_neighbours(analytics.graph_edges(_mentions(spark, d), graph=("doc_id",)), ("doc_id",))
    return rows.select("doc_id", "chunk", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


def hierarchy_levels(spark, d):
    return analytics.hierarchy(_chunks(spark, d), [PACK, 2048, 8192])


def hierarchy_parents(spark, d):
    return analytics.parents(analytics.hierarchy(_chunks(spark, d), [PACK, 2048, 8192]))


def hierarchy_children(spark, d):
    rows = analytics.children(analytics.hierarchy(_chunks(spark, d), [PACK, 2048, 8192]))
    return rows.select("doc_id", "level", "index", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


def topic_similarity(spark, d):
    rows = analytics.window_similarity_lists(_table(spark, d, "documents"), sentences.split("text"))
    return rows.select("doc_id", "pos", F.round("similarity", 6).alias("similarity"))


def topic_shifts(spark, d):
    rows = analytics.window_similarity_lists(_table(spark, d, "documents"), sentences.split("text"))
    return analytics.topic_shifts(rows.withColumn("similarity", F.round("similarity", 6)), threshold=0.2)


def evaluation(spark, d):
    """All scores of each chunk, with its document as source."""
    docs = _table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    chunks = F.transform(sentences.placed_windows(sentences.pack(sentences.split("content"), PACK)), lambda w, i: F.struct(i.alias("index"), w["bs"].alias("byte_start"), w["be"].alias("byte_end"), w["t"].alias("text")))
    rows = analytics.evaluate_lists(docs.select("doc_id", "content", chunks.alias("chunks")))
    rows = rows.withColumn("stable_id", sizing.stable_id(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), "index", "byte_start", "byte_end"))
    names = ("reconstruction", "density", "coverage", "coherence", "boundary_quality")
    return rows.select("stable_id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in names))


def overlap_groups(spark, d):
    return analytics.overlap_groups(_chunks(spark, d), PACK, 0.3)


def line_overlap(spark, d):
    return analytics.line_overlap(_chunks(spark, d), 1).select("doc_id", "index", "overlap_text")


def _budget_items(spark, d):
    rows = _chunks(spark, d)
    score = F.round((F.col("char_count") * 7 + F.col("nws_count") * 13) % 101 / 100, 2)
    return rows.select(F.col("doc_id").alias("query_id"), F.col("index").cast("bigint").alias("pos"), score.alias("score"), F.col("token_count").alias("size"))


def budget_greedy(spark, d):
    return analytics.budget_greedy(_budget_items(spark, d), 300)


def budget_dp(spark, d):
    return analytics.budget_dp(_budget_items(spark, d), 300)


def budget_select(spark, d):
    rows = analytics.budget_select(_budget_items(spark, d), 300)
    return rows.select("query_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("selected", "dropped")), "total", "budget", "strategy")


def order_yaml_sections(spark, d):
    return markup.key_sections(_order_text(spark, d, ": "), "yaml").select("o_custkey", "pos", "name", "section")


def order_toml_sections(spark, d):
    return markup.key_sections(_order_text(spark, d, "toml"), "toml").select("o_custkey", "pos", "name", "section")


def _order_text(spark, d, kind):
    o = _table(spark, d, "orders")
    key = F.concat(F.lit("order_"), "o_orderkey")
    body = F.concat_ws("\n", F.concat(F.lit("  status: "), "o_orderstatus"), F.concat(F.lit("  priority: "), "o_orderpriority")) if kind == ": " else F.concat_ws("\n", F.concat(F.lit('status = "'), "o_orderstatus", F.lit('"')))
    part = F.concat(key, F.lit(":\n"), body, F.lit("\n")) if kind == ": " else F.concat(F.lit("["), key, F.lit("]\n"), body, F.lit("\n"))
    rows = o.select("o_custkey", F.struct("o_orderkey", part.alias("p")).alias("x")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("x")).alias("l"))
    return rows.select("o_custkey", F.array_join(F.transform("l", lambda x: x["p"]), "").alias("text"))


def chunk_documents(spark, d):
    """Rows of the whole engine: detection, segmentation, packing and context in one Arrow pass."""
    docs = _table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n\n"), "text", F.lit("\n\n- item\n")).alias("content"))
    rows = chunking.chunk(docs, max_chunk_size=800, size_unit="chars")
    return rows.groupBy("doc_id").agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), F.sum(F.octet_length("text")).alias("bytes"), F.max(F.when(F.trim("text") == "", 1).otherwise(0)).alias("blank"))


def chunk_pages(spark, d):
    pages = _table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("page/"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"))
    rows = chunking.chunk(pages, max_chunk_size=1500, size_unit="chars")
    return rows.groupBy("doc_id").agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), F.sum(F.octet_length("text")).alias("bytes"), F.max(F.when(F.trim("text") == "", 1).otherwise(0)).alias("blank"))


def chunk_code(spark, d):
    """Python modules made of parts: one function for each part of a brand."""
    p = _together(_table(spark, d, "part"))
    body = F.concat(F.lit("def part_"), "p_partkey", F.lit("(count):\n    size = "), "p_size", F.lit("\n    return size * count\n\n\n"))
    x = p.select("p_brand", F.struct("p_partkey", body.alias("b")).alias("x")).groupBy("p_brand").agg(F.array_sort(F.collect_list("x")).alias("l"))
    code = x.select(F.xxhash64("p_brand").alias("doc_id"), F.concat("p_brand", F.lit(".py")).alias("path"), F.array_join(F.transform("l", lambda i: i["b"]), "").alias("content"))
    rows = chunking.chunk(code, max_chunk_size=400, size_unit="chars")
    return rows.groupBy("filepath").agg(F.max("byte_end").alias("bytes"), F.sum(F.octet_length("text")).alias("covered"), F.size(F.array_distinct(F.flatten(F.collect_list("entities.name")))).alias("functions"))


_HEADER = "import os\nfrom a.b import c as d\n\n\n"


def code_windows(spark, d):
    """Chunks of Python modules, one for each brand with a function for each part, with their whole context."""
    p = _together(_table(spark, d, "part"))
    body = F.concat(F.lit("def part_"), "p_partkey", F.lit("(count):\n    size = "), "p_size", F.lit("\n    return size * count\n\n\n"))
    x = p.select("p_brand", F.struct("p_partkey", body.alias("b")).alias("x")).groupBy("p_brand").agg(F.array_sort(F.collect_list("x")).alias("l"))
    code = x.select(F.xxhash64("p_brand").alias("doc_id"), F.concat(F.lit("parts/"), "p_brand", F.lit(".py")).alias("path"), F.concat(F.lit(_HEADER), F.array_join(F.transform("l", lambda i: i["b"]), "")).alias("content"))
    rows = chunking.chunk(code, max_chunk_size=400, size_unit="chars")
    near = [F.array_join(F.transform(F.filter("siblings", lambda x: x["position"] == side), lambda x: x["name"]), ",").alias(side) for side in ("before", "after")]
    return rows.select(
        "filepath", "language", "content_type", "section_type", "index", "total_chunks", "byte_start", "byte_end", "nws_count", "text", "contextualized_text", *near,
        F.array_join("entities.name", ",").alias("functions"), F.array_join("imports.name", ",").alias("imports"), F.size("scope").alias("n_scope"), F.exists("entities.is_partial", lambda x: x).alias("partial"),
    )


def code_quality(spark, d):
    """Quality of chunks that have entities: methods of classes, one class for each brand and size."""
    p = _table(spark, d, "part")
    name = F.concat(F.lit("K"), F.regexp_replace("p_brand", "[^0-9]", ""), F.lit("_"), "p_size")
    method = F.concat(F.lit("    def part_"), "p_partkey", F.lit("(self, count):\n        return count * "), "p_size", F.lit("\n\n"))
    x = p.select("p_brand", "p_size", name.alias("name"), F.struct("p_partkey", method.alias("b")).alias("x")).groupBy("p_brand", "p_size", "name").agg(F.array_sort(F.collect_list("x")).alias("l"))
    code = x.select(F.xxhash64("name").alias("doc_id"), F.concat("name", F.lit(".py")).alias("path"), F.concat(F.lit("class "), "name", F.lit(":\n"), F.array_join(F.transform("l", lambda i: i["b"]), "")).alias("content"))
    rows = analytics.quality_scores(chunking.chunk(code, max_chunk_size=100_000, size_unit="chars"), 0, 1000)
    return rows.select("filepath", "index", "integrity", F.round("scope_consistency", 6).alias("scope_consistency"), F.round("size_balance", 6).alias("size_balance"), "overall", F.array_join(F.array_distinct("entities.type"), ",").alias("types"))


def _by_brand(spark, d, piece, joint: str = "") -> DataFrame:
    """(doc, title, intro, text): a brand's pieces, one for each of its parts (key, name, note), joined."""
    number = F.regexp_replace("p_brand", "[^0-9]", "")
    p = _table(spark, d, "part").select(
        number.cast("bigint").alias("doc"), F.concat(F.lit("brand "), number).alias("title"), F.col("p_partkey").alias("key"), F.concat(F.lit("part_"), "p_partkey").alias("name"),
        F.concat("p_name", F.lit(", of type "), F.lower("p_type"), F.lit(" and of size "), "p_size", F.lit(".")).alias("note"),
    )
    x = _together(p, "doc").groupBy("doc", "title").agg(F.array_sort(F.collect_list(F.struct("key", piece.alias("p")))).alias("l"))
    return x.select("doc", "title", F.concat(F.lit("All parts of "), "title", F.lit(" in order.")).alias("intro"), F.array_join(F.transform("l", lambda i: i["p"]), joint).alias("text"))


def _cut(docs: DataFrame, path, content, limit: int) -> DataFrame:
    rows = chunking.chunk(docs.select(F.col("doc").alias("doc_id"), path.alias("path"), content.alias("content")), max_chunk_size=limit, min_chunk_size=0, size_unit="chars")
    return rows.select("doc_id", "language", "content_type", "section_type", "index", "total_chunks", "byte_start", "byte_end", "text", F.array_join("heading_hierarchy", " > ").alias("headings"), F.array_join("breadcrumb", " > ").alias("breadcrumb"))


def markdown_chunks(spark, d):
    """Headings of two levels, paragraphs and lists."""
    docs = _by_brand(spark, d, F.concat(F.lit("## "), "name", F.lit("\n\n"), "note", F.lit("\n\n- key "), "key", F.lit("\n\n")))
    return _cut(docs, F.concat("title", F.lit(".md")), F.concat(F.lit("# "), "title", F.lit("\n\n"), "intro", F.lit("\n\n"), "text"), 200)


def paragraph_chunks(spark, d):
    docs = _by_brand(spark, d, F.col("note"), "\n\n")
    return _cut(docs, F.concat("title", F.lit(".txt")), F.col("text"), 200)


def html_chunks(spark, d):
    docs = _by_brand(spark, d, F.concat(F.lit("<section><h2>"), "name", F.lit("</h2><p>"), "note", F.lit("</p></section>\n")))
    return _cut(docs, F.concat("title", F.lit(".html")), F.col("text"), 300)


def json_chunks(spark, d):
    docs = _by_brand(spark, d, F.concat(F.lit('  "'), "name", F.lit('": {"key": '), "key", F.lit(', "'), "name", F.lit('": []}')), ",\n")
    return _cut(docs, F.concat("title", F.lit(".json")), F.concat(F.lit("{\n"), "text", F.lit("\n}\n")), 100)


def yaml_chunks(spark, d):
    docs = _by_brand(spark, d, F.concat("name", F.lit(":\n  key: "), "key", F.lit("\n")))
    return _cut(docs, F.concat("title", F.lit(".yaml")), F.col("text"), 70)


def toml_chunks(spark, d):
    docs = _by_brand(spark, d, F.concat(F.lit("[parts."), "key", F.lit(']\nname = "'), "name", F.lit('"\n')))
    return _cut(docs, F.concat("title", F.lit(".toml")), F.col("text"), 70)


def cell_chunks(spark, d):
    """Percent cells: a prose and a code cell for each part."""
    docs = _by_brand(spark, d, F.concat(F.lit("# %% [markdown]\n"), "note", F.lit("\n# %%\nkey = "), "key", F.lit("\n")))
    return _cut(docs, F.concat("title", F.lit(".py")), F.col("text"), 400)


def fence_chunks(spark, d):
    """A fence of JSON in Markdown, cut by its language's engine."""
    docs = _by_brand(spark, d, F.concat(F.lit('"'), "name", F.lit('": '), "key"), ",\n")
    return _cut(docs, F.concat("title", F.lit(".md")), F.concat(F.lit("# "), "title", F.lit("\n\n```json\n{"), "text", F.lit("}\n```\n\n"), "intro", F.lit("\n")), 200)


def propositions(spark, d):
    return propositions_ops.extract(_table(spark, d, "documents")).select("doc_id", "text", "kind")


def diff_content(spark, d):
    """What two cuttings of the corpus say alike, wherever it is."""
    return analytics.diff(_chunks(spark, d), _chunks(spark, d, SMALL), mode="content")


QUERIES = {
    f.__name__: f
    for f in (
        doc_sizes, detect_language, sentence_split, conversation_sentences, sentence_pack, stable_ids, chunk_stats_by_lang, chunk_quality, dedup_exact, simhash_signature,
        simhash_pairs, simhash_dedup, minhash_signature, minhash_pairs, minhash_dedup, chunk_diff, diff_content, chunk_density, chunk_reconstruction, chunk_coverage, chunk_coherence,
        chunk_boundary_quality, evaluation, sentence_tfidf, semantic_boundaries, topic_similarity, topic_shifts, embedding_adjacent_cosine, vector_rows, weaviate_rows, supabase_rows, framework_rows,
        csv_round_trip, jsonl_round_trip, graph_nodes, graph_edges, graph_entity_chunks, graph_neighbours, hierarchy_levels, hierarchy_parents, hierarchy_children, overlap_groups,
        line_overlap, budget_greedy, budget_dp, budget_select, order_yaml_sections, order_toml_sections, chunk_documents, chunk_pages, chunk_code, code_windows, code_quality, markdown_chunks,
        paragraph_chunks, html_chunks, json_chunks, yaml_chunks, toml_chunks, cell_chunks, fence_chunks, propositions,
    )
}

# SQL:



def _split(text: str) -> str:
    """The sentences of a text as a list."""
    return f"""list_filter(string_split(regexp_replace(regexp_replace({text}, '(\\n\\n+)', '\\1\u0001', 'g'), '([.!?])(\\s+)([A-Z"''(\\[])', '\\1\\2\u0001\\3', 'g'), '\u0001'), lambda x: x <> '')"""


_SENT = """
sent as (
  select doc_id, lang, generate_subscripts(a, 1) - 1 as pos, unnest(a) as s from (
    select doc_id, lang, list_filter(string_split(
      regexp_replace(regexp_replace(coalesce(text, ''), '(\\n\\n+)', '\\1\u0001', 'g'), '([.!?])(\\s+)([A-Z"''(\\[])', '\\1\\2\u0001\\3', 'g'), '\u0001'), lambda x: x <> '') as a
    from documents))"""


def _packed(size: int, name: str = "chunks") -> str:
    """Chunk rows by a recursive fold over sentences."""
    return f"""
n_{name} as (select doc_id, max(pos) as last from sent group by doc_id),
fold_{name} as (
  select doc_id, pos, s as t, length(s) as n, 0 as w, lang from sent where pos = 0
  union all
  select f.doc_id, s.pos, case when f.n + length(s.s) <= {size} then f.t || s.s else s.s end,
         case when f.n + length(s.s) <= {size} then f.n + length(s.s) else length(s.s) end,
         case when f.n + length(s.s) <= {size} then f.w else f.w + 1 end, f.lang
  from fold_{name} f join sent s on s.doc_id = f.doc_id and s.pos = f.pos + 1),
win_{name} as (select doc_id, w, lang, arg_max(t, pos) as text from fold_{name} group by doc_id, w, lang),
{name} as (
  select doc_id, lang, 'doc/' || doc_id as filepath, w::int as "index", (count(*) over (partition by doc_id))::int as total_chunks,
    (coalesce(sum(strlen(text)) over (partition by doc_id order by w rows between unbounded preceding and 1 preceding), 0))::int as byte_start,
    (sum(strlen(text)) over (partition by doc_id order by w))::int as byte_end,
    (coalesce(sum(length(text) - length(replace(text, chr(10), ''))) over (partition by doc_id order by w rows between unbounded preceding and 1 preceding), 0))::int as line_start,
    (greatest(sum(length(text) - length(replace(text, chr(10), ''))) over (partition by doc_id order by w) - case when right(text, 1) = chr(10) then 1 else 0 end,
      coalesce(sum(length(text) - length(replace(text, chr(10), ''))) over (partition by doc_id order by w rows between unbounded preceding and 1 preceding), 0)))::int as line_end,
    len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))::int as token_count, length(text)::int as char_count,
    strlen(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]', '', 'g'))::int as nws_count, text
  from win_{name})"""


_CHUNKS = "with recursive" + _SENT + "," + _packed(PACK)
_ID = "sha256(filepath || chr(0) || \"index\" || chr(0) || byte_start || chr(0) || byte_end)"


_CHUNKS_4096 = "with recursive" + _SENT + "," + _packed(4096)
_GRAPH = _CHUNKS + """, m as (select distinct doc_id, "index" as key, unnest(regexp_extract_all(text, '\\p{Lu}\\p{Ll}+')) as name from chunks),
  p as (select doc_id, x.key as a, y.key as b, string_agg(name, ' ' order by name) as shared, count(*) as n_shared from m x join m y using (doc_id, name) where x.key < y.key group by all)"""


def _levels() -> str:
    return "".join(f"""
      i{k} as (select doc_id, "index", byte_start, byte_end, size, row_number() over (partition by doc_id order by "index") as r from {"(select doc_id, \"index\", byte_start, byte_end, char_count::bigint as size from chunks)" if k == 1 else f"h{k - 1}"}),
      f{k} as (select doc_id, r, greatest(size, 1) as n, 0 as g from i{k} where r = 1 union all
        select i.doc_id, i.r, case when f.n + greatest(i.size, 1) > {limit} then greatest(i.size, 1) else f.n + greatest(i.size, 1) end, case when f.n + greatest(i.size, 1) > {limit} then f.g + 1 else f.g end
        from f{k} f join i{k} i on i.doc_id = f.doc_id and i.r = f.r + 1),
      h{k} as (select i.doc_id, g::int as "index", min(byte_start) as byte_start, max(byte_end) as byte_end, sum(size)::bigint as size, min("index") as child_start, max("index") as child_end from f{k} join i{k} i using (doc_id, r) group by i.doc_id, g)"""
        + ("," if k == 1 else "") for k, limit in ((1, 2048), (2, 8192)))


_TOPIC = """
ws as (select doc_id, pos::int as pos, count(*) over b as n, count(*) over a as m, string_agg(s, '') over b as ta, string_agg(s, '') over a as tb from sent
  window b as (partition by doc_id order by pos rows between 4 preceding and current row), a as (partition by doc_id order by pos rows between 1 following and 5 following)),
wt as (select doc_id, pos, ta, tb from ws where n = 5 and m = 5),
wi as (select doc_id, pos, unnest(regexp_extract_all(lower(ta), '[a-z][a-z0-9]*')) as t, 1 as x from wt union all select doc_id, pos, unnest(regexp_extract_all(lower(tb), '[a-z][a-z0-9]*')), 0 from wt),
wc as (select doc_id, pos, t, sum(x) as a, sum(1 - x) as b from wi group by all),
wu as (select doc_id, pos, case when a > 0 then (1 + ln(a)) * i else 0.0::double end as u, case when b > 0 then (1 + ln(b)) * i else 0.0::double end as v from (select *, case when a > 0 and b > 0 then 1.0::double else ln(1.5::double) + 1 end as i from wc)),
wsim as (select wt.doc_id, wt.pos, round(coalesce(max(uv / nullif(sqrt(uu * vv), 0)), 0.0::double), 6) as similarity from wt left join (select doc_id, pos, sum(u * v) as uv, sum(u * u) as uu, sum(v * v) as vv from wu group by all) using (doc_id, pos) group by all)"""


def _folded(pieces: str, limit: int) -> str:
    """Rows of engine chunks: pieces of a document (doc_id, r, n, e, head, crumb, kind; e is where a piece ends) packed by their sizes n.

    A chunk begins where the one before ended; the last one ends with the document, ``whole`` (doc_id, content, language, type).
    """
    return f"""
pieces as ({pieces}),
folds as (select doc_id, r, n, 0 as g from pieces where r = 1 union all
  select p.doc_id, p.r, case when f.n + p.n <= {limit} then f.n + p.n else p.n end, case when f.n + p.n <= {limit} then f.g else f.g + 1 end from folds f join pieces p on p.doc_id = f.doc_id and p.r = f.r + 1),
ends as (select doc_id, g, max(e) as e, arg_min(head, r) as headings, arg_min(crumb, r) as breadcrumb, arg_min(kind, r) as section_type from folds join pieces using (doc_id, r) group by doc_id, g),
spans as (select *, coalesce(lag(e) over w, 0) as a, case when lead(e) over w is null then length(content) else e end as b, (count(*) over (partition by doc_id))::int as total_chunks from ends join whole using (doc_id) window w as (partition by doc_id order by g))
select doc_id, language, type as content_type, section_type, g::int as "index", total_chunks, strlen(content[1:a])::int as byte_start, strlen(content[1:b])::int as byte_end, content[a + 1:b] as text, headings, breadcrumb from spans"""


def _brands(piece: str, before: str = "''", joint: str = "''", after: str = "''", language: str = "", kind: str = "") -> str:
    """``whole`` and ``ns`` (doc_id, name, i, off, piece): each part's piece of its brand's document and where it begins."""
    return f"""with recursive
np as (select *, 'brand ' || doc_id as title, 'All parts of brand ' || doc_id || ' in order.' as intro, row_number() over (partition by doc_id order by key) as i from (
  select regexp_replace(p_brand, '[^0-9]', '', 'g')::bigint as doc_id, p_partkey as key, 'part_' || p_partkey as name, p_name || ', of type ' || lower(p_type) || ' and of size ' || p_size || '.' as note from part)),
nq as (select *, {piece} as piece from np),
whole as (select doc_id, {before} || string_agg(piece, {joint} order by i) || {after} as content, '{language}' as language, '{kind}' as type from nq group by doc_id, title, intro),
ns as (select *, length({before}) + coalesce(sum(length(piece) + length({joint})) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as off from nq),"""


_SIMPLE = "select doc_id, i as r, {n} as n, {e} as e, {head} as head, {crumb} as crumb, {kind} as kind from ns"
_CODE_SQL = f"""with recursive
fs as (select p_brand, p_partkey as k, 'def part_' || p_partkey || '(count):' || chr(10) || '    size = ' || p_size || chr(10) || '    return size * count' as body, row_number() over (partition by p_brand order by p_partkey) as r from part),
sz as (select *, length(regexp_replace(body, '\\s', '', 'g')) as n, {len(_HEADER)} + coalesce(sum(length(body) + 3) over (partition by p_brand order by r rows between unbounded preceding and 1 preceding), 0) as off from fs),
fo as (select p_brand, r, 25 + n as n, 0 as g from sz where r = 1 union all
  select s.p_brand, s.r, case when f.n + s.n <= 400 then f.n + s.n else s.n end, case when f.n + s.n <= 400 then f.g else f.g + 1 end from fo f join sz s on s.p_brand = f.p_brand and s.r = f.r + 1),
gr as (select p_brand, r, case when g > 0 and sum(sz.n) over (partition by p_brand, g) < 50 then g - 1 else g end as g from fo join sz using (p_brand, r)),
ch as (select p_brand, g, min(r) as lo, max(r) as hi, max(off + length(body)) as e, string_agg('part_' || k, ',' order by r) as functions from gr join sz using (p_brand, r) group by p_brand, g),
doc as (select p_brand, '{_HEADER.replace(chr(10), "' || chr(10) || '")}' || string_agg(body || chr(10) || chr(10) || chr(10), '' order by r) as content, max(r) as m from sz group by p_brand),
sp as (select *, coalesce(lag(e) over w, 0) as a, case when lead(e) over w is null then length(content) else e end as b, (count(*) over (partition by p_brand))::int as total_chunks from ch join doc using (p_brand) window w as (partition by p_brand order by g)),
rw as (select *, content[a + 1:b] as text, (select string_agg('part_' || k, ',' order by r) from sz s where s.p_brand = sp.p_brand and s.r between lo - 3 and lo - 1) as bef, (select string_agg('part_' || k, ',' order by r) from sz s where s.p_brand = sp.p_brand and s.r between hi + 1 and hi + 3) as aft,
  (select string_agg('def part_' || k || '(count)', ', ' order by r) from sz s where s.p_brand = sp.p_brand and s.r between lo and least(hi, lo + 4)) as sig from sp)
select 'parts/' || p_brand || '.py' as filepath, 'python' as language, 'code' as content_type, 'code' as section_type, g::int as "index", total_chunks, a::int as byte_start, b::int as byte_end, length(regexp_replace(text, '\\s', '', 'g'))::int as nws_count, text,
  '# parts/' || p_brand || '.py' || chr(10) || '# Language: python' || chr(10) || '# Defines: ' || sig || chr(10) || '# Uses: os, d' || coalesce(chr(10) || '# After: ' || replace(bef, ',', ', '), '') || coalesce(chr(10) || '# Before: ' || replace(aft, ',', ', '), '') || chr(10) || chr(10) || text as contextualized_text,
  coalesce(bef, '') as before, coalesce(aft, '') as after, functions, 'os,d' as imports, 0 as n_scope, false as partial from rw"""


def _tfidf(texts: str, group: str, item: str, vocab: int) -> str:
    """Common tables up to ``tf_w(group, item, term, w)`` for a table of (group, item, text)."""
    return f"""
tf_terms as (select {group}, {item}, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]*')) as term from {texts}),
tf_c as (select {group}, {item}, term, count(*) as tf from tf_terms group by all),
tf_n as (select {group}, count(distinct {item}) as n_items from {texts} group by all),
tf_d as (select *, row_number() over (partition by {group} order by df desc, term) as r from (select {group}, term, count(*) as df from tf_c group by all)),
tf_r as (select c.{group}, c.{item}, c.term, (1 + ln(tf)) * (ln((1 + n_items)::double / (1 + df)) + 1) as raw
  from tf_c c join tf_d d on c.{group} = d.{group} and c.term = d.term and d.r <= {vocab} join tf_n n on n.{group} = c.{group}),
tf_w as (select {group}, {item}, term, raw / sqrt(sum(raw * raw) over (partition by {group}, {item})) as w from tf_r)"""


_SIG = """
w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) as t from documents),
c as (select doc_id, t, count(*) as n from w group by all),
h as (select doc_id, n, ('0x' || substr(md5(t), 17, 16))::ubigint as h from c),
bits as (select doc_id, b, sum(case when (h >> b) & 1 = 1 then n else -n end) as s from h, (select unnest(range(64))::ubigint as b) group by all),
sig as (select d.doc_id, coalesce(v, 0::ubigint) as v from documents d left join (select doc_id, sum(case when s >= 0 then (1::hugeint << b::int) else 0 end)::ubigint as v from bits group by all) using (doc_id))"""
_EDGES = f"""
bands as (select doc_id, v, i, (v >> (16 * i)::ubigint) & 65535 as k from sig, (select unnest(range(4)) as i)),
edges as materialized (select distinct a.doc_id as a, b.doc_id as b from bands a join bands b on a.i = b.i and a.k = b.k and a.doc_id < b.doc_id where bit_count(xor(a.v, b.v)::bit) <= 9)"""
_CLASS_EDGES = _EDGES + ", cls as (select doc_id, min(doc_id) over (partition by v) as class from sig)"
#: Links between classes, counted for each class.
_LINKS = """,
ce as (select distinct x.class as a, y.class as b from edges e join cls x on x.doc_id = e.a join cls y on y.doc_id = e.b where x.class <> y.class),
ends as (select a as class, b as other from ce union select b, a from ce)
select doc_id, class, (select count(*) from ends e where e.class = c.class) as n_links from cls c"""
_MIN = """
toks as (select doc_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'))) as tokens from documents),
hs as (select doc_id, ('0x' || substr(md5(t), 1, 8))::ubigint as h from (select doc_id, unnest(tokens) as t from toks)),
ks as (select k::ubigint as k, (xor((k * 2654435769)::ubigint, ((k & 31) << 27)::ubigint) & 4294967295::ubigint) as mask from (select unnest(range(32)) as k)),
ms as (select t.doc_id, k, coalesce(min(xor(h, mask)), 0) as m from toks t cross join ks left join hs on hs.doc_id = t.doc_id group by all)"""
_MIN_EDGES = """
mb as (select doc_id, k // 4 as band, list(m order by k) as v from ms group by all),
cand as (select distinct a.doc_id as a, b.doc_id as b from mb a join mb b on a.band = b.band and a.v = b.v and a.doc_id < b.doc_id),
edges as materialized (select a, b from cand join toks x on x.doc_id = a join toks y on y.doc_id = b
  where len(list_distinct(list_concat(x.tokens, y.tokens))) = 0 or len(list_intersect(x.tokens, y.tokens)) * 10000 >= len(list_distinct(list_concat(x.tokens, y.tokens))) * 8500)"""
#: The first maximal independent set: rows in order of keys, each with the kept neighbours before it.
_MIS = """,
nodes as materialized (select doc_id, row_number() over (order by doc_id) as r, (select coalesce(list(a), []) from edges where b = doc_id) as smaller from documents),
mis as (
  select 0::bigint as r, []::bigint[] as kept, null::bigint as doc_id, null::bigint as k
  union all
  select n.r, case when len(list_intersect(n.smaller, m.kept)) = 0 then list_append(m.kept, n.doc_id) else m.kept end, n.doc_id, coalesce(list_min(list_intersect(n.smaller, m.kept)), n.doc_id)
  from mis m join nodes n on n.r = m.r + 1)
select doc_id, k as kept from mis where doc_id is not null"""

_LADDER_SQL = " ".join(f"when regexp_matches(content, '{p}') then '{x}'" for p, x in ((r"(?m)^#{1,6}\s+\S", "markdown"), (r"(?is)^\s*<!doctype html|^\s*<html\b|<(?:div|body|head|section|article)\b[^>]*>", "html"), (r"(?s)^\s*[\{\[]", "json"), (r"(?m)^\s*(?:async +)?def +\w+ *\(", "python"), (r"(?m)^\s*(?:export|interface|type|const|let|function)\s+\w+", "typescript")))

ORACLES = {
    "doc_sizes": r"""select doc_id, length(text)::int as chars, strlen(text)::int as bytes, strlen(regexp_replace(text, '[\t\n\x0B\f\r ]', '', 'g'))::int as nws_bytes,
        length(regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g'))::int as nws_chars, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))::int as words from documents""",
    "detect_language": f"""with x as (
        select 'd' || doc_id as key, source || '/' || doc_id || ['.md', '.py', '.json.txt', '', '.yaml', '.d.ts', '.unknown'][doc_id % 7 + 1] as path, text as content from documents
        union all select 'p' || page_id, 'page', html from pages),
      y as (select *, case when path like '%.md' then 'markdown' when path like '%.py' then 'python' when path like '%.json.txt' then 'plaintext' when path like '%.yaml' then 'yaml'
        when path like '%.d.ts' then 'typescript' {_LADDER_SQL}
        when regexp_matches(content, '\\bpackage\\s+\\w+') and regexp_matches(content, '\\bfunc\\s+\\w+') then 'go'
        when regexp_matches(content, '\\bfn\\s+\\w+') and regexp_matches(content, '\\b(?:impl|let|pub)\\b') then 'rust' else 'plaintext' end as language from x)
      select key, path, language, case when regexp_matches(content, '(?m)^# %%') then 'hybrid' when language in ('html', 'json', 'toml', 'xml', 'yaml') then 'markup'
        when language in ('latex', 'markdown', 'plaintext', 'rst') then 'prose' else 'code' end as content_type from y""",
    "sentence_split": "with " + _SENT + """ select doc_id, pos::int as pos, s as sentence,
        coalesce(sum(length(s)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::int as char_start,
        coalesce(sum(strlen(s)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::int as byte_start from sent""",
    "conversation_sentences": "with " + _SENT.replace("doc_id, lang,", "conv_id || '/' || turn as id,").replace("select conv_id || '/' || turn as id, generate", "select id, generate").replace("from documents", "from conversations") + " select id, pos::int as pos, s as sentence from sent",
    "sentence_pack": _CHUNKS + ' select doc_id, filepath, "index", total_chunks, byte_start, byte_end, line_start, line_end, token_count, char_count, nws_count, text from chunks',
    "stable_ids": _CHUNKS + f' select doc_id, "index", {_ID} as stable_id from chunks',
    "chunk_stats_by_lang": _CHUNKS + " select lang, count(*) as total_chunks, round(avg(char_count), 4) as avg_size, min(char_count) as min_size, max(char_count) as max_size from chunks group by lang",
    "chunk_quality": _CHUNKS + """, b as (select *, greatest(0.0::double, 1.0::double - abs(char_count - 281.0::double) / 231.0::double) as sb from chunks)
      select doc_id, "index", round(sb, 6) as size_balance, round(0.45::double + 0.30::double + 0.25::double * sb, 4) as overall from b""",
    "dedup_exact": "select doc_id, min(doc_id) over (partition by coalesce(text, 'null ' || doc_id)) as kept from documents",
    "simhash_signature": "with " + _SIG + " select doc_id, case when v > 9223372036854775807 then (v::hugeint - 18446744073709551616)::bigint else v::bigint end as simhash from sig",
    "simhash_pairs": "with " + _SIG + "," + _CLASS_EDGES + _LINKS,
    "simhash_dedup": "with recursive" + _SIG + "," + _EDGES + _MIS,
    "minhash_signature": "with " + _MIN + " select t.doc_id, len(tokens)::int as n_tokens, string_agg(m::varchar, ',' order by k) as signature from toks t join ms using (doc_id) group by t.doc_id, tokens",
    "minhash_pairs": "with " + _MIN + "," + _MIN_EDGES + ", cls as (select doc_id, min(doc_id) over (partition by tokens) as class from toks)" + _LINKS,
    "minhash_dedup": "with recursive" + _MIN + "," + _MIN_EDGES + _MIS,
    "chunk_diff": _CHUNKS + "," + _packed(SMALL, "small") + f""", o as (select distinct {_ID} as stable_id from chunks), n as (select distinct {_ID} as stable_id from small)
      select coalesce(o.stable_id, n.stable_id) as stable_id, case when o.stable_id is null then 'added' when n.stable_id is null then 'removed' else 'unchanged' end as status from o full join n on o.stable_id = n.stable_id""",
    "chunk_density": _CHUNKS + ' select doc_id, "index", round(nws_count::double / char_count, 6) as density from chunks',
    "chunk_reconstruction": _CHUNKS + " select doc_id, count(*) as n_chunks, 1.0::double as reconstruction from chunks group by doc_id",
    "chunk_coverage": _CHUNKS + """, x as (select c.doc_id, c."index", list_distinct(regexp_extract_all(lower(c.text), '[a-z][a-z0-9]*')) as own, theirs
        from chunks c, (select list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z][a-z0-9]*')))) as theirs from benchmark))
      select doc_id, "index", round(case when len(own) > 0 then len(list_intersect(own, theirs))::double / len(own) else 1.0 end, 6) as coverage from x""",
    "sentence_tfidf": "with " + _SENT + ", t as (select doc_id, pos::int as pos, s as text from sent)," + _tfidf("t", "doc_id", "pos", 4096) + " select doc_id, pos, term, round(w, 6) as w from tf_w",
    "embedding_adjacent_cosine": """with x as (select vec_id, embedding, lead(embedding) over (order by vec_id) as n from embeddings)
      select vec_id, round(list_cosine_similarity(embedding::double[], n::double[]), 6) as similarity from x where n is not null""",
    "semantic_boundaries": "with " + _SENT + """, a as (select doc_id, pos::int as pos, coalesce(sum(strlen(s)) over (partition by doc_id order by pos rows between 1 preceding and 1 following), 0)::bigint as n from sent),
      e as (select doc_id, pos, (n % 97)::double as x, ((n // 97) % 97)::double as y, lead((n % 97)::double) over w as x2, lead(((n // 97) % 97)::double) over w as y2, lead(pos) over w as nx from a window w as (partition by doc_id order by pos)),
      s as (select doc_id, pos, case when x * x + y * y = 0 or x2 * x2 + y2 * y2 = 0 then 0.0::double else (x * x2 + y * y2) / (sqrt(x * x + y * y) * sqrt(x2 * x2 + y2 * y2)) end as sim from e where nx is not null)
      select doc_id, pos, round(sim, 6) as similarity, sim < 0.9::double or coalesce(sim < lag(sim) over v and sim < lead(sim) over v, false) as is_boundary from s window v as (partition by doc_id order by pos)""",
    "vector_rows": _CHUNKS_4096 + f' select {_ID} as id, len(embedding)::int as n_values, filepath, "index"::varchar as "index", byte_end::varchar as byte_end, text from chunks join embeddings on vec_id = doc_id',
    "weaviate_rows": _CHUNKS_4096 + """ select 'Chunk' as class, embedding[1]::double as v0,
      '{"byte_end":"' || byte_end || '","byte_start":"' || byte_start || '","filepath":"' || filepath || '","index":"' || "index" || '"}' as properties, text from chunks join embeddings on vec_id = doc_id""",
    "supabase_rows": _CHUNKS_4096 + f' select {_ID} as stable_id, text as content, embedding[64]::double as v63, "index", filepath, byte_start, byte_end from chunks join embeddings on vec_id = doc_id',
    "framework_rows": _CHUNKS + f" select {_ID} as id, text as page_content, line_start::varchar as line_start, token_count::varchar as token_count, filepath from chunks",
    "csv_round_trip": "select 'doc/' || doc_id || '.txt' as filepath, strlen(text)::int as byte_end, 0 as entity_count, 'paragraph' as section_type, md5(text) as text from documents where trim(text) <> ''",
    "jsonl_round_trip": "select doc_id, 'doc/' || doc_id || '.txt' as filepath, 'plaintext' as language, strlen(text)::int as byte_end, 0 as n_entities, 0 as n_metadata, text, text as contextualized_text from documents where trim(text) <> ''",
    "graph_nodes": _GRAPH + " select doc_id, name, count(*) as n_chunks from m group by doc_id, name having count(*) >= 2",
    "graph_edges": _GRAPH + """, z as (select doc_id, key, count(*) as n from m group by all)
      select doc_id, a, b, shared, n_shared, round(n_shared::double / (za.n + zb.n - n_shared), 6) as weight from p join z za using (doc_id) join z zb using (doc_id) where za.key = a and zb.key = b""",
    "graph_entity_chunks": _GRAPH + " select doc_id, name, string_agg(key::varchar, ',' order by key) as chunks from m group by doc_id, name",
    "graph_neighbours": _GRAPH + " select doc_id, chunk, string_agg(other::varchar, ',' order by other) as neighbours from (select doc_id, a as chunk, b as other from p union select doc_id, b, a from p) group by doc_id, chunk",
    "chunk_coherence": _CHUNKS + f""", ids as (select {_ID} as sid, text from chunks),
      parts as (select sid, generate_subscripts(a, 1) - 1 as pos, unnest(a) as text from (select sid, {_split('text')} as a from ids)),
      {_tfidf("parts", "sid", "pos", 4096)},
      near as (select a.sid, a.pos, sum(a.w * b.w) as s from tf_w a join tf_w b on a.sid = b.sid and b.pos = a.pos + 1 and a.term = b.term group by all),
      steps as (select p.sid, coalesce(s, 0.0::double) as s from (select *, lead(pos) over (partition by sid order by pos) as nx from parts) p left join near n on n.sid = p.sid and n.pos = p.pos where nx is not null)
      select i.sid as stable_id, round(coalesce(m, 1.0::double), 6) as coherence from ids i left join (select sid, avg(s) as m from steps group by sid) using (sid)""",
    "chunk_boundary_quality": _CHUNKS + f""", ids as (select {_ID} as sid, doc_id, "index", {_split('text')} as a from chunks),
      two as (select sid, lag(a) over (partition by doc_id order by "index") as before, a from ids),
      parts as (select sid, 0 as pos, array_to_string(list_slice(before, greatest(len(before) - 1, 1), len(before)), '') as text from two where before is not null union all select sid, 1, array_to_string(list_slice(a, 1, 2), '') from two where before is not null),
      {_tfidf("parts", "sid", "pos", 4096)},
      near as (select a.sid, sum(a.w * b.w) as s from tf_w a join tf_w b on a.sid = b.sid and a.pos = 0 and b.pos = 1 and a.term = b.term group by all)
      select t.sid as stable_id, round(case when before is not null then 1 - coalesce(s, 0.0::double) end, 6) + 0.0::double as boundary_quality from two t left join near using (sid)""",
    "hierarchy_levels": _CHUNKS + "," + _levels() + """
      select doc_id, 0 as level, "index", byte_start, byte_end, char_count::bigint as size, null::int as child_start, null::int as child_end from chunks
      union all select doc_id, 1, "index", byte_start, byte_end, size, child_start, child_end from h1 union all select doc_id, 2, "index", byte_start, byte_end, size, child_start, child_end from h2""",
    "hierarchy_parents": _CHUNKS + "," + _levels() + """
      select c.doc_id, 0 as level, c."index", h."index" as parent from chunks c join h1 h on h.doc_id = c.doc_id and c."index" between child_start and child_end
      union all select c.doc_id, 1, c."index", h."index" from h1 c join h2 h on h.doc_id = c.doc_id and c."index" between h.child_start and h.child_end union all select doc_id, 2, "index", null from h2""",
    "hierarchy_children": _CHUNKS + "," + _levels() + """
      select doc_id, 1 as level, "index", array_to_string(range(child_start, child_end + 1), ',') as children from h1 union all select doc_id, 2, "index", array_to_string(range(child_start, child_end + 1), ',') from h2""",
    "topic_similarity": "with " + _SENT + "," + _TOPIC + " select doc_id, pos, similarity from wsim",
    "topic_shifts": "with recursive" + _SENT + "," + _TOPIC + """, low as (select doc_id, pos, row_number() over (partition by doc_id order by pos) as r from wsim where similarity < 0.2::double),
      tf as (select doc_id, r, pos as last, true as taken from low where r = 1 union all
        select l.doc_id, l.r, case when l.pos - f.last >= 3 then l.pos else f.last end, l.pos - f.last >= 3 from tf f join low l on l.doc_id = f.doc_id and l.r = f.r + 1)
      select doc_id, pos from tf join low using (doc_id, r) where taken""",
    "line_overlap": _CHUNKS + """, l as (select *, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') as ls from chunks)
      select doc_id, "index", lag(coalesce(ls[-1], '')) over (partition by doc_id order by "index") as overlap_text from l""",
    "overlap_groups": _CHUNKS + """, g as (select doc_id, unnest(range(0, max("index") + 1)) as g from chunks group by doc_id)
      select c.doc_id, (g.g // 2)::int as "index", min(byte_start) as byte_start, max(byte_end) as byte_end, string_agg(text, '' order by c."index") as text
      from g join chunks c on c.doc_id = g.doc_id and g.g % 2 = 0 and c."index" >= g.g and c."index" < g.g + 3 group by c.doc_id, g.g""",
    "budget_greedy": _CHUNKS + """, i as (select doc_id as query_id, "index"::bigint as pos, greatest(token_count, 1) as size, row_number() over (partition by doc_id order by round((char_count * 7 + nws_count * 13) % 101 / 100.0::double, 2) desc, "index") as r from chunks),
      f as (select query_id, pos, r, case when size <= 300 then size else 0 end as used, size <= 300 as selected from i where r = 1
        union all select i.query_id, i.pos, i.r, case when f.used + i.size <= 300 then f.used + i.size else f.used end, f.used + i.size <= 300 from f join i on i.query_id = f.query_id and i.r = f.r + 1)
      select query_id, pos, selected from f""",
    "budget_dp": _CHUNKS + """, i as (select doc_id as query_id, "index"::bigint as pos, greatest(token_count, 1) as size, round((char_count * 7 + nws_count * 13) % 101 / 100.0::double, 2) as score, row_number() over (partition by doc_id order by "index") as r from chunks),
      k as (select distinct query_id, 0::bigint as r, list_transform(range(301), lambda w: {'s': 0.0::double, 'm': []::bigint[]}) as b from i union all
        select i.query_id, i.r, list_transform(range(301), lambda w: case when w >= i.size and b[w - i.size + 1].s + i.score > b[w + 1].s + 1e-12::double then {'s': b[w - i.size + 1].s + i.score, 'm': list_append(b[w - i.size + 1].m, i.pos)} else b[w + 1] end)
        from k join i on i.query_id = k.query_id and i.r = k.r + 1),
      best as (select query_id, arg_max(b, r) as b from k group by query_id),
      took as (select query_id, list_filter(b, lambda x: x.s >= list_max(list_transform(b, lambda y: y.s)) - 1e-12::double)[1].m as m from best)
      select query_id, pos, list_contains(m, pos) as selected, 'dp' as strategy from i join took using (query_id)""",
    "budget_select": _CHUNKS + """, i as (select doc_id as query_id, "index"::bigint as pos, greatest(token_count, 1) as size, row_number() over (partition by doc_id order by round((char_count * 7 + nws_count * 13) % 101 / 100.0::double, 2) desc, "index") as r from chunks),
      f as (select query_id, pos, r, size, case when size <= 300 then size else 0 end as used, size <= 300 as selected from i where r = 1
        union all select i.query_id, i.pos, i.r, i.size, case when f.used + i.size <= 300 then f.used + i.size else f.used end, f.used + i.size <= 300 from f join i on i.query_id = f.query_id and i.r = f.r + 1)
      select query_id, coalesce(string_agg(pos::varchar, ',' order by pos) filter (selected), '') as selected, coalesce(string_agg(pos::varchar, ',' order by pos) filter (not selected), '') as dropped,
        (coalesce(sum(size) filter (selected), 0))::bigint as total, 300 as budget, 'greedy' as strategy from f group by query_id""",
    "diff_content": _CHUNKS + "," + _packed(SMALL, "small") + """, o as (select distinct sha256(filepath || chr(0) || text) as content_sha from chunks), n as (select distinct sha256(filepath || chr(0) || text) as content_sha from small)
      select coalesce(o.content_sha, n.content_sha) as content_sha, case when o.content_sha is null then 'added' when n.content_sha is null then 'removed' else 'unchanged' end as status from o full join n on o.content_sha = n.content_sha""",
    "evaluation": "with recursive e as materialized (@coherence), q as materialized (@boundary)," + _SENT.replace("sent as", "sent as") + "," + _packed(PACK) + f""" select {_ID} as stable_id, 1.0::double as reconstruction, round(nws_count::double / char_count, 6) as density, 1.0::double as coverage, e.coherence, q.boundary_quality
      from chunks join e on e.stable_id = {_ID} join q on q.stable_id = {_ID}""",
    "markdown_chunks": _brands("'## ' || name || chr(10) || chr(10) || note || chr(10) || chr(10) || '- key ' || key || chr(10) || chr(10)", "'# ' || title || chr(10) || chr(10) || intro || chr(10) || chr(10)", language="markdown", kind="prose") + _folded("""
      select doc_id, row_number() over (partition by doc_id order by e) as r, n, e, head, head as crumb, kind from (
        select distinct doc_id, length(title) + 2 as n, length(title) + 2 as e, title as head, 'heading' as kind from ns
        union all select distinct doc_id, length(intro), length(title) + 4 + length(intro), title, 'paragraph' from ns
        union all select doc_id, length(name) + 3, off + length(name) + 3, title || ' > ' || name, 'heading' from ns
        union all select doc_id, length(note), off + length(name) + 5 + length(note), title || ' > ' || name, 'paragraph' from ns
        union all select doc_id, length(key::varchar) + 6, off + length(piece) - 2, title || ' > ' || name, 'list' from ns)""", 200),
    "paragraph_chunks": _brands("note", joint="chr(10) || chr(10)", language="plaintext", kind="prose") + _folded(_SIMPLE.format(n="length(piece)", e="off + length(piece)", head="''", crumb="''", kind="'paragraph'"), 200),
    "html_chunks": _brands("'<section><h2>' || name || '</h2><p>' || note || '</p></section>' || chr(10)", language="html", kind="markup") + _folded(_SIMPLE.format(n="length(piece) - case when i = 1 then 1 else 0 end", e="off + length(piece) - 1", head="''", crumb="'section'", kind="'html'"), 300),
    "json_chunks": _brands("'  \"' || name || '\": {\"key\": ' || key || ', \"' || name || '\": []}'", "'{' || chr(10)", "',' || chr(10)", "chr(10) || '}' || chr(10)", "json", "markup")
      + _folded("""select doc_id, i as r, e - coalesce(lag(e) over (partition by doc_id order by i), 0) as n, e, '' as head, name as crumb, 'json' as kind from (
        select *, case when i = count(*) over (partition by doc_id) then (select length(content) from whole w where w.doc_id = ns.doc_id) else off + length(piece) + 1 end as e from ns)""", 100),
    "yaml_chunks": _brands("name || ':' || chr(10) || '  key: ' || key || chr(10)", language="yaml", kind="markup") + _folded(_SIMPLE.format(n="length(piece)", e="off + length(piece)", head="''", crumb="name", kind="'yaml'"), 70),
    "toml_chunks": _brands("'[parts.' || key || ']' || chr(10) || 'name = \"' || name || '\"' || chr(10)", language="toml", kind="markup") + _folded(_SIMPLE.format(n="length(piece)", e="off + length(piece)", head="''", crumb="'parts > ' || key", kind="'toml'"), 70),
    "cell_chunks": "select * replace (case section_type when 'heading' then 'markdown' else 'python' end as language) from (" + _brands("'# %% [markdown]' || chr(10) || note || chr(10) || '# %%' || chr(10) || 'key = ' || key || chr(10)", kind="hybrid") + _folded("""
      select doc_id, 2 * i - 1 as r, 1 as n, off + 17 + length(note) as e, '%% [markdown]' as head, '%% [markdown]' as crumb, 'heading' as kind from ns union all select doc_id, 2 * i, 1, off + length(piece), '', '', 'code' from ns""", 0) + ")",
    "fence_chunks": "select * replace (case section_type when 'code_block' then 'json' else 'markdown' end as language) from (" + _brands("'\"' || name || '\": ' || key", "'# ' || title || chr(10) || chr(10) || '```json' || chr(10) || '{'", "',' || chr(10)", "'}' || chr(10) || '```' || chr(10) || chr(10) || intro || chr(10)", kind="prose") + _folded("""
      select doc_id, row_number() over (partition by doc_id order by e) as r, n, e, head, crumb, kind from (
        select distinct doc_id, 1000 as n, length(title) + 2 as e, title as head, title as crumb, 'heading' as kind from ns
        union all select doc_id, length(piece) + case when i = count(*) over (partition by doc_id) then 3 else 2 end, off + length(piece) + case when i = count(*) over (partition by doc_id) then 5 else 1 end, title, title || ' > ' || name, 'code_block' from ns
        union all select doc_id, 1000, length(content), title, title, 'paragraph' from whole join (select distinct doc_id, title from ns) using (doc_id))""", 200) + ")",
    "propositions": "with " + _SENT + """, f as (
      select doc_id, pos, k, kind, trim(unnest(regexp_extract_all(s, p)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as text from sent, (values
        (1, 'copula_is', '(?m)\\b[A-Z][a-z]+(?:\\s+[a-z]+){0,6}\\s+is\\s+[^.!?]+(?:\\.|$)'), (2, 'defined_as', '(?m)\\b[A-Z][^\\n:]{1,64}\\s*:\\s*[^\\n]+'),
        (3, 'numeric_claim', '(?i)\\b(?:at least|about|approximately|over|under|less than|more than)\\s+[\\d,]+(?:\\.\\d+)?%?\\b[^.!?]*[.!?]'),
        (4, 'year_claim', '\\b(?:after|before|in|since|until)\\s+(?:the\\s+)?(?:year\\s+)?\\d{4}\\b[^.!?]*[.!?]')) x(k, kind, p))
      select doc_id, text, kind from f""",
    "code_windows": _CODE_SQL,
    "code_quality": """with c as (select 'K' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '_' || p_size as name, p_partkey, p_size from part),
      x as (select name, count(*) as n, 8 + length(name) + sum(length('    def part_' || p_partkey || '(self, count):' || chr(10) || '        return count * ' || p_size) + 2) as size from c group by name),
      q as (select *, case when n >= 0 then 1.0::double end as labels, greatest(0.0::double, 1.0::double - abs(size - 500.0::double) / 500.0::double) as sb from x)
      select name || '.py' as filepath, 0 as "index", 1.0::double as integrity, 1.0::double as scope_consistency, round(sb, 6) as size_balance, round(0.45::double + 0.30::double + 0.25::double * sb, 4) as overall, 'class,method' as types from q""",
    "order_yaml_sections": """select o_custkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as pos, 'order_' || o_orderkey as name,
      'order_' || o_orderkey || ':' || chr(10) || '  status: ' || o_orderstatus || chr(10) || '  priority: ' || o_orderpriority || chr(10) as section from orders""",
    "order_toml_sections": """select o_custkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as pos, 'order_' || o_orderkey as name,
      '[order_' || o_orderkey || ']' || chr(10) || 'status = "' || o_orderstatus || '"' || chr(10) as section from orders""",
    "chunk_documents": "select doc_id, 0 as byte_start, n::int as byte_end, n as bytes, 0 as blank from (select doc_id, strlen('# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || text || chr(10) || chr(10) || '- item' || chr(10)) as n from documents)",
    "chunk_pages": "select page_id as doc_id, 0 as byte_start, strlen(html)::int as byte_end, strlen(html) as bytes, 0 as blank from pages",
    "chunk_code": """select p_brand || '.py' as filepath, sum(strlen('def part_' || p_partkey || '(count):' || chr(10) || '    size = ' || p_size || chr(10) || '    return size * count' || chr(10) || chr(10) || chr(10)))::int as bytes,
      sum(strlen('def part_' || p_partkey || '(count):' || chr(10) || '    size = ' || p_size || chr(10) || '    return size * count' || chr(10) || chr(10) || chr(10)))::bigint as covered, count(distinct p_partkey)::int as functions from part group by p_brand""",
}
# Scores of chunks by name, each stated once.
ORACLES["evaluation"] = ORACLES["evaluation"].replace("@coherence", ORACLES["chunk_coherence"]).replace("@boundary", ORACLES["chunk_boundary_quality"])
