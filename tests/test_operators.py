"""Operators against SQL on the smallest tables, and on odd rows."""

import json
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kerf import plugins, registry, rpc
from kerf.functions import sizing
from kerf.operators import analytics, chunking, dedup, export, markup, propositions, semantic, sentences
from kerf.operators.store import Store
from kerf.sources import files
from kerf.streaming import stream

SF = "/root/testdata/sf0.001"
#: Those that differ most in how they are planned; the driver compares all.
COMPARED = ("markdown_chunks", "fence_chunks", "cell_chunks", "json_chunks", "code_windows", "topic_shifts", "budget_dp", "budget_select", "propositions", "minhash_pairs", "graph_neighbours", "hierarchy_parents", "jsonl_round_trip", "doc_sizes", "detect_language", "sentence_split", "sentence_pack", "stable_ids", "chunk_stats_by_lang", "dedup_exact", "simhash_dedup", "minhash_dedup", "chunk_diff", "chunk_coherence", "semantic_boundaries", "embedding_adjacent_cosine", "graph_edges", "hierarchy_levels", "overlap_groups", "budget_greedy", "order_yaml_sections", "chunk_documents", "chunk_pages", "chunk_code")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", COMPARED)
def test_query_is_what_its_sql_says(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())


def test_entry_module(spark):
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_sentences_and_packing_of_odd_texts(spark):
    rows = docs_of(spark, [(1, "A b. C d! (E) \"F\"\n\nx. y"), (2, ""), (3, None), (4, "é. É. A")])
    got = {}
    for r in sentences.sentences(rows).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert got == {1: ["A b. ", "C d! ", "(E) \"F\"\n\n", "x. y"], 4: ["é. É. ", "A"]}
    marked = docs_of(spark, [(1, "a\x01b. C d\x01\x03. E \x01\x02f"), (2, "\x01")])
    held = {}
    for r in sentences.sentences(marked).orderBy("doc_id", "pos").collect():
        held.setdefault(r.doc_id, []).append((r.sentence, r.byte_start))
    assert held == {1: [("a\x01b. ", 0), ("C d\x01\x03. ", 5), ("E \x01\x02f", 12)], 2: [("\x01", 0)]}
    cut = markup.key_sections(docs_of(spark, [(1, "# \x01\na: 1\nb: \x01x\n")]), "yaml").orderBy("pos").collect()
    assert [(r.name, r.section) for r in cut] == [("a", "# \x01\na: 1\n"), ("b", "b: \x01x\n")]
    packed = rows.select("doc_id", sentences.pack(sentences.split(F.coalesce("text", F.lit(""))), 11, min_size=5).alias("w"))
    assert {r.doc_id: r.w for r in packed.collect()} == {1: ["A b. C d! ", "(E) \"F\"\n\nx. y"], 2: [], 3: [], 4: ["é. É. A"]}


def test_chunk_rows_reconstruct(spark):
    rows = docs_of(spark, [(1, "Añb. Cd.\nE f. G\n"), (2, "")])
    got = sentences.chunk_rows(rows, sentences.pack(sentences.split("text"), 6)).orderBy("index").collect()
    data = "Añb. Cd.\nE f. G\n".encode()
    assert [r.text.encode() for r in got] == [data[r.byte_start : r.byte_end] for r in got] and "".join(r.text for r in got).encode() == data
    assert got[-1].line_end == 1 and got[0].total_chunks == len(got)


def test_independent_set_is_the_sequential_one(spark):
    rng = np.random.default_rng(9)
    for _ in range(3):
        n = 40
        edges = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (70, 2)) if a != b}
        kept = {}
        for i in range(n):
            near = [a for a, b in edges if b == i and kept[a] == a]
            kept[i] = min(near, default=i)
        got = dedup.first_kept(spark.range(n).withColumnRenamed("id", "doc_id"), spark.createDataFrame(sorted(edges), "a bigint, b bigint"))
        assert {r.doc_id: r.kept for r in got.collect()} == kept


def test_duplicates_of_equal_and_empty_texts(spark):
    rows = docs_of(spark, [(i, "the same words in each") for i in range(15)] + [(20, None), (21, None), (22, "")])
    got = {r.doc_id: r.kept for r in dedup.dedup(rows, "minhash").collect()}
    assert [k for k in range(15) if got[k] == k] == [0]
    exact = {r.doc_id: r.kept for r in dedup.dedup(rows).collect()}
    assert exact[14] == 0 and exact[20] == 20 and exact[21] == 21
    assert dedup.simhash(docs_of(spark, [(1, "")])).first().simhash == 0
    with pytest.raises(ValueError):
        dedup.dedup(rows, "other")


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, budget = 9, int(rng.integers(5, 30))
        s, z = rng.integers(1, 20, n).astype(float), rng.integers(1, 12, n)
        chosen = analytics.knapsack(s, z, budget)
        best = max((sum(s[i] for i in range(n) if m >> i & 1), -sum(z[i] for i in range(n) if m >> i & 1)) for m in range(1 << n) if sum(z[i] for i in range(n) if m >> i & 1) <= budget)
        assert (s[chosen].sum(), -z[chosen].sum()) == best


def test_quality_literals(spark):
    entity = "array<struct<name:string,parent:string,is_partial:boolean>>"
    rows = spark.createDataFrame([(24, [("a", None, False)]), (12, [("a", None, False), ("b", "p", True)])], f"char_count int, entities {entity}")
    a, b = analytics.quality_scores(rows, 12, 36).collect()
    assert (a.integrity, a.scope_consistency, a.size_balance, a.overall) == (1.0, 1.0, 1.0, 1.0)
    assert (b.integrity, b.scope_consistency, b.size_balance, b.overall) == (0.5, 0.75, 0.0, 0.45)
    assert analytics.chunk_stats(rows).first().avg_size == 18.0


def test_engine_rows_errors_and_evaluation(spark):
    docs = spark.createDataFrame([(1, "a.py", b"import os\n\ndef f():\n    return os.sep\n"), (2, "b.txt", b"\xff\xfe"), (3, "c.md", None), (4, "d.md", "# T\n\nOne is a thing. Two is it.\n".encode())], "doc_id bigint, path string, content binary")
    rows = chunking.chunk(docs, max_chunk_size=60, size_unit="chars").cache()
    bad = rows.where("error is not null").collect()
    assert [r.doc_id for r in bad] == [2] and "UnicodeDecodeError" in bad[0].error
    good = export.with_stable_id(rows.where("error is null"))
    assert sorted({r.doc_id for r in good.collect()}) == [1, 4]
    scores = analytics.evaluate(good, docs.select("doc_id", F.col("content").cast("string").alias("content")))
    report = analytics.evaluation_report(scores).first()
    assert report.reconstruction == 1.0 and report.coverage == 1.0 and report.boundary_quality is None
    assert analytics.entity_distribution(good).collect()[0].type == "function"
    assert chunking.chunk(docs.limit(0)).count() == 0


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a.md", "# T\n\nSome text.\n")], "doc_id bigint, path string, content string")
    chunks = chunking.chunk(docs).cache()
    ids = export.with_stable_id(chunks)
    vectors = ids.select("stable_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    row = export.pinecone(chunks, vectors, namespace="n").first()
    assert row.values is not None and row["values"] == [1.0, 2.0] and row.namespace == "n" and row.metadata["filepath"] == "a.md"
    import hashlib

    assert row.id == hashlib.sha256(f"a.md\0{0}\0{0}\0{len('# T\n\nSome text.\n')}".encode()).hexdigest()
    assert set(export.weaviate(chunks, vectors).columns) == {"class", "vector", "properties"}
    assert "content" in export.supabase(chunks, vectors).columns and export.framework_documents(chunks).first().page_content
    with pytest.raises(ValueError):
        export.pinecone(chunks, vectors.limit(0))
    export.write_csv(chunks, str(tmp_path / "csv"))
    assert len(spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "csv")).columns) == 17
    export.write_jsonl(chunks, str(tmp_path / "json"))
    assert export.read_jsonl(spark, str(tmp_path / "json")).first().asDict(True) == chunks.first().asDict(True)


def test_directory_store_and_stream(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub" / ".git").mkdir(parents=True)
    (root / "a.md").write_text("# A\n\nText of a.\n")
    (root / "sub" / "b.py").write_text("def one():\n    return 1\n")
    (root / "sub" / ".git" / "c.txt").write_text("hidden")
    (root / "bad.txt").write_bytes(b"\xff")
    listing = lambda: files.read_directory(spark, str(root), exclude=("*.log",))
    assert sorted(r.path for r in listing().collect()) == ["a.md", "bad.txt", "sub/b.py"]
    assert sorted(r.path for r in files.read_directory(spark, str(root), include_hidden=True, exclude=("sub",)).collect()) == ["a.md", "bad.txt"]
    rows = files.chunk_directory(spark, str(root))
    assert {r.filepath: r.error is None for r in rows.collect()} == {"a.md": True, "bad.txt": False, "sub/b.py": True}
    found = lambda glob: sorted(r.path for r in files.read_directory(spark, str(root), glob=glob).collect())
    assert (found("sub/**/*.py"), found("*.py"), found("**/*.py"), found("sub/*"), found("[ab].md"), found("*/?.py")) == (["sub/b.py"], [], ["sub/b.py"], ["sub/b.py"], ["a.md"], ["sub/b.py"])

    store = Store(spark, str(tmp_path / "store"))
    assert store.chunks().count() == 0
    good = listing().where("error is null")
    first = store.sync(good)
    assert (first["indexed"], first["skipped"], first["added"]) == (2, 0, 2)
    assert store.sync(good)["skipped"] == 2
    kept = os.stat(root / "a.md")
    (root / "a.md").write_text("# A\n\nText of b.\n")
    os.utime(root / "a.md", ns=(kept.st_atime_ns, kept.st_mtime_ns))
    assert store.sync(listing().where("error is null"))["indexed"] == 1, "an edit that keeps size and time"
    (root / "a.md").write_text("# A\n\nAnother text of a, longer.\n")
    (root / "sub" / "b.py").unlink()
    spark.catalog.clearCache()
    third = store.sync(listing().where("error is null"))
    assert (third["indexed"], third["deleted"], third["removed"], third["added"]) == (1, 1, 2, 1)
    assert not [x for x in os.listdir(tmp_path / "store") if x.startswith("_next")] and os.path.exists(tmp_path / "store" / "CURRENT")
    assert [r.text for r in store.query("a.md").collect()] == ["# A\n\nAnother text of a, longer.\n"]

    got = []
    chunks = stream.chunk_stream(stream.read_stream(spark, str(root)))
    q = stream.upsert(chunks, lambda texts: [[float(len(t))] for t in texts], lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert len(got) == 2 - 1 and got[0]["values"][0] > 0 and got[0].metadata["total_chunks"] == "-1"


def test_semantic_chunks_and_topic_shifts(spark):
    text = "Cats purr. Cats sleep. " * 5 + "Stocks fell. Markets crashed. " * 5
    rows = docs_of(spark, [(1, text), (2, ""), (3, None)])
    got = semantic.semantic_chunks(rows, sizing.mock_embedding, max_size=40).orderBy("index").collect()
    assert "".join(r.text for r in got) == text and all(r.char_count <= 40 for r in got)
    near = analytics.adjacent_similarity(sentences.sentences(rows).withColumnRenamed("sentence", "text"), ["doc_id"], "pos")
    assert [r.pos for r in analytics.topic_shifts(near.withColumn("similarity", F.when(F.col("pos").isin(2, 3, 6), 0.1).otherwise(0.9))).orderBy("pos").collect()] == [2, 6]


def test_propositions(spark):
    text = "Spark is an engine.\n\nThe MIT license applies since 1999. Nothing here"
    got = propositions.extract(docs_of(spark, [(1, "é " + text), (2, None)])).collect()
    data = ("é " + text).encode()
    assert [(r.kind, r.text, r.confidence) for r in got] == [("copula_is", "Spark is an engine.", 0.7248), ("year_claim", "since 1999.", 0.5528)]
    assert all(data[r.byte_start : r.byte_end].decode().strip() == r.text for r in got)
    several = propositions.heuristic("Term: it is over 50% of all. Since 2001 and before 1990 it grew.")
    assert [(k, t) for *_, t, k, _ in several] == [("defined_as", "Term: it is over 50% of all."), ("numeric_claim", "over 50% of all."), ("year_claim", "before 1990 it grew.")]
    model = lambda t: json.dumps([{"text": "MIT license", "confidence": "high"}, "not there"])
    with pytest.warns(UserWarning, match="isn't in the text"):
        assert propositions.by_model(text, model) == [(text.index("MIT"), text.index("MIT") + 11, "MIT license", "model", 0.5)]
    with pytest.warns(UserWarning, match="can't be read"):
        assert propositions.by_model(text, lambda t: "no JSON") == []
    good = lambda t: json.dumps([{"text": "MIT license", "confidence": 0.9}])
    assert [(r.text, r.confidence) for r in propositions.extract(docs_of(spark, [(1, text)]), model=good).collect()] == [("MIT license", 0.9)]


def test_plugins_and_rpc(spark, tmp_path):
    plugins.register_formatter("count", lambda df: df.agg(F.count("*").alias("n")))
    with pytest.raises(ValueError):
        plugins.register_formatter("count", None)
    docs = spark.createDataFrame([(1, "x.zig", "fn main() {}\n")], "doc_id bigint, path string, content string")
    assert plugins.format_chunks("count", chunking.chunk(docs)).first().n == 1 and plugins.formatters() == ["count"]
    plugins.clear_formatters()

    def broken(path, text):
        raise RuntimeError("no")

    row = chunking.chunk(docs, {"zig": broken}, language="zig", content_type="code").first()
    assert row.parse_errors == ["RuntimeError: no"]
    path = tmp_path / "a.py"
    path.write_text("def f():\n    x = 1\n    return x\n")
    answer = rpc.handle(spark, json.dumps({"jsonrpc": "2.0", "id": 1, "method": "chunk_file", "params": {"path": str(path)}}).encode())
    assert answer["result"][0]["entities"][0]["name"] == "f"
    twice = answer["result"] + [answer["result"][0] | {"index": 1}]
    graph = rpc.handle(spark, json.dumps({"id": 2, "method": "build_graph", "params": {"chunks": twice}}).encode())
    assert graph["result"]["nodes"] == [{"name": "f", "n_chunks": 2}] and graph["result"]["edges"][0]["weight"] == 1.0 and graph["result"]["edges"][0]["shared"] == ["f"]
    assert [rpc.handle(spark, b)["error"]["code"] for b in (b"{", b"[]", b'{"method": "none"}', b'{"method": "chunk_file", "params": {"path": "/none"}}')] == [-32700, -32600, -32601, -32000]


def test_folds_are_computed_once(spark):
    rows = registry.packed(docs_of(spark, [(1, "A b. C d.")]).withColumn("lang", F.lit("en")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text") + plan.count("regexp_replace(coalesce(text") <= 3, plan


def test_copies_are_classes(spark):
    rows = docs_of(spark, [(k, "one two three four five six seven eight nine ten") for k in (3, 5, 9)] + [(4, "one two three four five six seven eight nine ten eleven"), (7, "other"), (8, None), (6, "")])
    signed = dedup.minhash(rows)
    got = {r.doc_id: (r["class"], r.n_links) for r in dedup.classes(signed, "digest", dedup.minhash_edges(signed)).collect()}
    assert {k: got[k][0] for k in got} == {3: 3, 5: 3, 9: 3, 4: 4, 7: 7, 8: 6, 6: 6} and got[7][1] == 0 and got[3][1] == got[4][1] == got[9][1]
    kept = {r.doc_id: r.kept for r in dedup.dedup(rows, "minhash").collect()}
    assert kept[5] == kept[9] == 3 and kept[8] == 6 and kept[7] == 7


def test_budget_selection(spark):
    words = "hello world " * 10
    items = [(1, 0, 1.0, 20, words), (1, 1, 0.9, 20, words + "again"), (1, 2, 0.5, 15, "quite other words"), (1, 3, 0.5, 0, ""), (2, 0, 0.1, 50, "too large"), (3, 0, 0.2, 1, ""), (3, 1, 0.3, 1, " ")]
    rows = spark.createDataFrame(items, "query_id bigint, pos bigint, score double, size int, text string")
    got = {r.query_id: r for r in analytics.budget_select(rows, 36, deduplicate=True, threshold=0.6).collect()}
    assert (got[1].selected, got[1].dropped, got[1].total) == ([0, 2, 3], [1], 36) and (got[2].selected, got[2].dropped) == ([], [0]) and got[3].selected == [1]
    by_score = {r.query_id: r.selected for r in analytics.budget_select(rows, 40, preserve_order=False).collect()}
    assert by_score[1] == [0, 1] and by_score[3] == [1, 0]
    exact = {r.query_id: (r.selected, r.strategy) for r in analytics.budget_select(rows, 36, "dp").collect()}
    assert exact[1] == ([0, 2, 3], "dp")
    assert {r.strategy for r in analytics.budget_dp(rows, 36, max_cells=40).collect()} == {"greedy", "dp"}
    for bad in ({"strategy": "best"}, {"deduplicate": True, "threshold": 0}):
        with pytest.raises(ValueError):
            analytics.budget_select(rows, 10, **bad)


def _tfidf_cosine(a, b):
    import re
    from collections import Counter

    x, y = (Counter(re.findall("[a-z][a-z0-9]*", t.lower())) for t in (a, b))
    w = [{t: (1 + math.log(n)) * (math.log(3 / (1 + (t in x) + (t in y))) + 1) for t, n in c.items()} for c in (x, y)]
    norms = [math.sqrt(sum(v * v for v in c.values())) for c in w]
    return sum(v * w[1].get(t, 0) for t, v in w[0].items()) / (norms[0] * norms[1]) if all(norms) else 0.0


def test_topic_shifts_of_windows(spark):
    cats, stocks = ["Cats purr loudly. ", "Cats sleep. ", "Kittens and cats play. "], ["Stocks fell. ", "Markets crashed today. ", "Traders sold stocks. "]
    said = cats * 3 + stocks * 3
    rows = sentences.sentences(docs_of(spark, [(1, "".join(said)), (2, "One. Two. Three."), (3, "1. (2. (3. (4. (5. (6. (7. (8. (9. (10. (11"), (4, None)]))
    near = {(r.doc_id, r.pos): r.similarity for r in analytics.window_similarity(rows).collect()}
    assert {p for d, p in near if d == 1} == set(range(4, 13)) and not any(d == 2 for d, _ in near) and near[3, 4] == 0
    for p in range(4, 13):
        assert near[1, p] == pytest.approx(_tfidf_cosine("".join(said[p - 4 : p + 1]), "".join(said[p + 1 : p + 6])))
    got = [r.pos for r in analytics.topic_shifts(analytics.window_similarity(rows)).where("doc_id = 1").orderBy("pos").collect()]
    assert 8 in got or any(abs(p - 8) <= 2 for p in got)
    assert all(b - a >= 3 for a, b in zip(got, got[1:]))


def test_graph_lookups_and_trees(spark):
    mentions = spark.createDataFrame([(1, 0, "f"), (1, 1, "f"), (1, 1, "g"), (1, 2, "g"), (1, 3, "h"), (2, 0, "f")], "doc_id bigint, key int, name string")
    edges = analytics.graph_edges(mentions, graph=("doc_id",))
    assert {(r.a, r.b): (r.shared, r.weight) for r in edges.collect()} == {(0, 1): (["f"], 0.5), (1, 2): (["g"], 0.5)}
    assert {(r.doc_id, r.name): r.chunks for r in analytics.entity_chunks(mentions, graph=("doc_id",)).collect()}[1, "f"] == [0, 1]
    assert {r.chunk: r.neighbours for r in analytics.chunk_neighbours(edges, ("doc_id",)).collect()} == {0: [1], 1: [0, 2], 2: [1]}

    import kerf

    source = "\n".join(f"def foo{i}(x):\n    return x * {i}\n" for i in range(20))
    tree = kerf.hierarchical_chunk("m.py", source, [64, 128, 512]).cache()
    parent = {(r.level, r["index"]): r.parent for r in analytics.parents(tree).collect()}
    below = {(r.level, r["index"]): r.children for r in analytics.children(tree).collect()}
    node = {(r.level, r["index"]): r for r in tree.collect()}
    top = {r["index"] for r in analytics.roots(tree).collect()}
    assert analytics.leaves(tree).count() == sum(k[0] == 0 for k in node) and {k[1] for k, p in parent.items() if p is None} == top
    for (level, i), kids in below.items():
        assert all(parent[level - 1, k] == i for k in kids)
        assert node[level, i].byte_start == node[level - 1, kids[0]].byte_start and node[level, i].byte_end == node[level - 1, kids[-1]].byte_end
    leaf = kerf.chunk("m.py", source, max_chunk_size=64, min_chunk_size=16, size_unit="chars")
    merged = {(r.level, r["index"]): [e.name for e in r.entities] for r in analytics.merged_context(tree, leaf).collect()}
    assert sorted(n for (level, _), names in merged.items() if level == 2 for n in set(names)) == sorted(f"foo{i}" for i in range(20))
    with pytest.raises(ValueError):
        kerf.hierarchical_chunk("m.py", source, [64])


def test_facade(spark, tmp_path):
    import kerf

    path = tmp_path / "a.md"
    path.write_text("# T\n\nSome text of it.\n", encoding="utf-8")
    rows = kerf.chunk_file(str(path)).collect()
    assert rows[0].text == path.read_text() and [r.text for r in kerf.chunk("a.md", path.read_text()).collect()] == [rows[0].text]
    assert {r.filepath for r in kerf.chunk_directory(str(tmp_path)).collect()} == {"a.md"}
    chunker = kerf.Chunker(max_chunk_size=40, min_chunk_size=5, size_unit="chars")
    before = chunker.chunk("b.txt", "hello world\n\n" * 10)
    diff = {r.status: r["count"] for r in chunker.chunk_diff("b.txt", "hello world\n\n" * 10 + "goodbye\n\n" * 5, before).groupBy("status").count().collect()}
    assert diff["added"] > 0 and diff["unchanged"] > 0
    moved = {r.status for r in chunker.chunk_diff("b.txt", "hello world\n\n" * 10, before, mode="content").collect()}
    assert moved == {"unchanged"}
    assert chunker.chunk_stats(before).first().max_size <= 40 and kerf.dedup(docs_of(spark, [(1, "a")])).count() == 1
    nodes, edges = kerf.build_chunk_graph(kerf.chunk("m.py", "def f():\n    return 1\n"), 1)
    assert nodes.first().name == "f" and edges.count() == 0 and "chunk" in kerf.__all__
    with pytest.raises(AttributeError):
        kerf.nothing
    with pytest.raises(TypeError):
        kerf.Chunker(max_size=3)


def test_semantic_option_routes_prose():
    from kerf.kernels import engine
    from kerf.plans.options import Options

    text = "Cats purr. Cats sleep. Cats eat. Stocks fell. Markets crashed. Stocks rose."
    embed = lambda texts: [[t.count("Cats") + 0.01, t.count("Stocks") + t.count("Markets")] for t in texts]
    o = Options(semantic=True, semantic_embed_fn=embed, semantic_window=1, size_unit="chars")
    assert [r["text"] for r in engine.chunk("a.txt", text, o)] == ["Cats purr. Cats sleep. Cats eat. ", "Stocks fell. Markets crashed. Stocks rose."]
    small = engine.chunk("a.txt", text, Options(semantic=True, semantic_embed_fn=embed, semantic_window=1, size_unit="chars", max_chunk_size=20))
    assert "".join(r["text"] for r in small) == text and all(r["char_count"] <= 20 for r in small)
    by_word = engine.chunk("a.txt", text, Options(semantic=True, semantic_embed_fn=embed, semantic_window=1, size_unit="chars", semantic_min_sentences=3, semantic_sentence_splitter=lambda t: t.split(". ")))
    assert "".join(r["text"] for r in by_word) == text and len(by_word) == 2
    assert engine.chunk("m.py", "x = 1\n", o)[0]["section_type"] == "code"
    with pytest.raises(ValueError):
        Options(semantic=True)
