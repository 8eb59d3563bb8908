"""Steps that must not grow faster than their tables: nothing is shuffled or kept that needn't be, with the results of plain versions."""

import gc
import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerf import registry
from kerf.kernels import code, engine, markup, near, signatures, tfidf
from kerf.operators import analytics, chunking, dedup, export, sentences
from kerf.plans.options import Options

SF = "/root/testdata/sf0.001"
SAID = "Cats purr here. Cats sleep. " * 9 + "Stocks fell. Markets crashed. Cats sold stocks. " * 4 + "1. (2. (3."


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_boundary_quality_shuffles_no_terms(spark):
    assert shuffles(registry.QUERIES["chunk_boundary_quality"](spark, SF)) == 0
    docs = docs_of(spark, [(1, SAID), (2, "One."), (3, ""), (4, SAID[::-1])])
    kept = sentences.chunk_rows(docs, sentences.pack(sentences.split("text"), 60), before=True)
    got = {r.stable_id: r.boundary_quality for r in analytics.boundary_quality(kept).collect()}
    # By windows over chunk rows, and by the relational form over pairs of texts.
    assert got == {r.stable_id: r.boundary_quality for r in analytics.boundary_quality(kept.drop("before")).collect()}
    rows = sorted((r.doc_id, r["index"], r.stable_id, r.s) for r in kept.select("doc_id", "index", "stable_id", sentences.split("text").alias("s")).collect())
    two = [(b[2], k, t) for a, b in zip(rows, rows[1:]) if a[0] == b[0] for k, t in enumerate(("".join(a[3][-2:]), "".join(b[3][:2])))]
    near = {r.sid: 1 - r.similarity for r in analytics.adjacent_similarity(spark.createDataFrame(two, "sid string, pos int, text string"), ["sid"], "pos").collect()}
    assert len(near) > 5 and {k for k, v in got.items() if v is None} == {r[2] for r in rows} - set(near)
    assert all(got[k] == pytest.approx(v) for k, v in near.items())


def test_coherence_shuffles_no_terms(spark):
    assert shuffles(registry.QUERIES["chunk_coherence"](spark, SF)) == 0
    rows = docs_of(spark, [(1, SAID), (2, "One."), (3, ""), (4, "One. Two.")]).withColumn("stable_id", F.col("doc_id"))
    near = analytics.adjacent_similarity(sentences.sentences(rows).withColumnRenamed("sentence", "text"), ["doc_id"], "pos").groupBy("doc_id").agg(F.avg("similarity").alias("m"))
    want = {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0} | {r.doc_id: r.m for r in near.collect()}
    got = {r.stable_id: r.coherence for r in analytics.coherence(rows).collect()}
    assert got == pytest.approx(want) and 0 < got[1] < 1 and got[4] == 0


def test_vocabulary_is_the_most_frequent_terms_of_each_group():
    lists = pa.array([["b a", "a c b", "zz a"], [], ["d", None]])
    items, offsets = signatures.flat(lists)
    groups = np.repeat(np.arange(3), np.diff(offsets))
    item, term, w, names = tfidf.weights(items, groups, 2)
    assert [(i, names[t].as_py()) for i, t in zip(item, term)] and {(int(i), names[int(t)].as_py()) for i, t in zip(item, term)} == {(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "a"), (3, "d")}
    assert np.bincount(item, w * w) == pytest.approx(np.ones(4))


def test_evaluation_joins_no_sources_to_chunks(spark):
    assert shuffles(registry.QUERIES["evaluation"](spark, SF)) == 0
    docs = docs_of(spark, [(1, SAID), (2, "Ärger. Öl."), (3, "x y")])
    chunks = sentences.chunk_rows(docs, sentences.pack(sentences.split("text"), 60), keep=()).withColumn("more", F.create_map(F.lit("k"), F.col("index")))
    sources = docs_of(spark, [(1, SAID), (2, "Ärger. XL.")]).withColumnRenamed("text", "content")
    got = {(r.doc_id, r["index"]): r for r in analytics.evaluate(chunks, sources).collect()}
    assert len(got) == chunks.count() and all(r.reconstruction == r.coverage == 1 for (d, _), r in got.items() if d == 1)
    assert got[2, 0].reconstruction == 0 and got[2, 0].coverage == 0.5 and got[3, 0].coverage is None and got[3, 0].reconstruction is None
    for scores, name in ((analytics.coherence(chunks), "coherence"), (analytics.boundary_quality(chunks), "boundary_quality")):
        assert {r.stable_id: r[name] for r in scores.collect()} == {r.stable_id: r[name] for r in got.values()}
    assert got[1, 1].more == {"k": 1}


def test_topic_windows_shuffle_no_terms(spark):
    assert shuffles(registry.QUERIES["topic_similarity"](spark, SF)) == 0
    docs = docs_of(spark, [(1, SAID), (2, "One. Two."), (3, SAID * 3), (4, None)])
    got = {(r.doc_id, r.pos): r.similarity for r in analytics.window_similarity_lists(docs, sentences.split("text")).collect()}
    n = {r.doc_id: r.n for r in sentences.sentences(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {(d, p) for d in (1, 3) for p in range(4, n[d] - 5)}
    assert got == {(r.doc_id, r.pos): r.similarity for r in analytics.window_similarity(sentences.sentences(docs)).collect()}


def test_topic_shifts_shuffle_positions_only(spark):
    plan = registry.QUERIES["topic_shifts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Window" not in plan and "explode" not in plan.split("MapInArrow")[1]


def test_sentence_tfidf_shuffles_nothing(spark):
    assert shuffles(registry.QUERIES["sentence_tfidf"](spark, SF)) == 0
    docs = docs_of(spark, [(1, SAID), (2, "b a. A c b. Zz a."), (3, ""), (4, None), (5, "1. (2.")])
    for vocab in (4096, 2):
        want = {(r.doc_id, r.pos, r.term): r.w for r in analytics.tfidf(sentences.sentences(docs), ["doc_id"], "pos", "sentence", vocab).collect()}
        got = {(r.doc_id, r.pos, r.term): r.w for r in analytics.tfidf_lists(docs, sentences.split("text"), max_vocab=vocab).collect()}
        assert got == pytest.approx(want) and len(got) > 5


def test_simhash_hashes_each_word_once(spark, monkeypatch):
    texts = ["a b c a", "", None, "Öl öl ÖL", "x_1 " * 70000 + "y"] + [f"w{k} w{k * 7 % 50} z" for k in range(200)]
    plan = dedup.simhash(docs_of(spark, list(enumerate(texts))))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan

    def plain(text):
        n = Counter(re.findall(r"\w+", (text or "").lower()))
        h = {w: int(hashlib.md5(w.encode()).hexdigest()[16:], 16) for w in n}
        v = sum(1 << b for b in range(64) if sum(k if h[w] >> b & 1 else -k for w, k in n.items()) >= 0) if n else 0
        return v - (v >> 63 << 64)

    words = pa.array([re.findall(r"\w+", (t or "").lower()) for t in texts])
    for most in (1 << 16, 7):
        monkeypatch.setattr(signatures, "BITS_AT_ONCE", most)
        assert signatures.simhash(words).to_pylist() == signatures.simhash(words.slice(0)).to_pylist() == [plain(t) for t in texts]
        assert signatures.simhash(words.slice(3, 5)).to_pylist() == [plain(t) for t in texts[3:8]]
    rows = docs_of(spark, list(enumerate(texts)))
    assert [r.simhash for r in dedup.simhash(rows).orderBy("doc_id").collect()] == [plain(t) for t in texts]


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_embedding_similarity_has_every_neighbour(spark, partitions):
    rng = np.random.default_rng(5)
    vectors = {int(k): rng.normal(size=64).astype(np.float32) for k in rng.permutation(3000)}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "vec_id bigint, embedding array<float>").repartition(8)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    try:
        # Small partitions are joined, by their sizes, when the plan runs.
        for c, v in zip(before, (partitions, "60k", "false", "10k")):
            spark.conf.set(c, v)
        got = analytics.embedding_similarity(rows).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(r.vec_id for r in got) == list(range(2999))
    for r in got:
        a, b = vectors[r.vec_id].astype(float), vectors[r.vec_id + 1].astype(float)
        assert r.similarity == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_embedding_similarity_of_few_and_null_vectors(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "vec_id bigint, embedding array<float>")
    assert analytics.embedding_similarity(rows()).count() == analytics.embedding_similarity(rows((1, [1.0]))).count() == 0
    got = analytics.embedding_similarity(rows((1, [1.0, 0.0]), (2, None), (3, [2.0, 0.0]), (4, [0.0, 0.0]))).collect()
    assert sorted((r.vec_id, r.similarity) for r in got if r.similarity is not None) == [(3, 0.0)] and {r.vec_id for r in got} == {2, 3}


def test_csv_keeps_every_character(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = [" a ", "\ta\n", "\r\na", "a\r\nb", "a\rb", '"', '""', 'x\0"y', "\x1fa\x1f", "\0", "a\\", "null", ",", '"' * 2_500_001, 'a\r\n"' * 700_000]
    texts += ["".join(rng.choice(list('"\\,\n\r \t\0é') + ["ab", '"\n'], rng.choice([3, 30]))) + "." for _ in range(500)]
    docs = spark.createDataFrame([(k, f"{k}.txt", t) for k, t in enumerate(texts)], "doc_id bigint, path string, content string").repartition(3)
    rows = chunking.chunk(docs, max_chunk_size=10_000_000, size_unit="chars", context_mode="none")
    export.write_csv(rows, f"{tmp_path}/csv")
    got = {r.filepath: r for r in export.read_csv(spark, f"{tmp_path}/csv").collect()}
    want = {r.filepath: r for r in rows.collect()}
    assert len(want) == len(texts) and got.keys() == want.keys()
    assert all(got[p].text == r.text and int(got[p].byte_end) == r.byte_end for p, r in want.items())


def signed_of(spark, n=600):
    """Signatures near 20 centres, so that most share a band with many others."""
    rng = np.random.default_rng(11)
    centres = rng.integers(-(2**63), 2**63, 20)
    rows = {}
    for k in rng.permutation(n):
        h = int(centres[k % 20])
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            h ^= -(2**63) if b == 63 else 1 << int(b)
        rows[int(k)] = h
    return spark.createDataFrame(list(rows.items()), "doc_id bigint, simhash bigint").repartition(3).cache()


def test_kept_signatures_without_a_list_of_links(spark, monkeypatch):
    signed = signed_of(spark)
    edges = dedup.simhash_edges(signed)
    every = signed.groupBy("simhash").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    want = {r.doc_id: r.kept for r in dedup.first_kept(every, edges).collect()}
    assert 20 <= len(set(want.values())) < len(want) < 600
    monkeypatch.setattr(dedup, "simhash_edges", None)
    for most in (1 << 18, 90, 1000):
        monkeypatch.setattr(dedup, "RANGE", most)
        monkeypatch.setattr(near, "BASE", 16)
        assert {r["class"]: r.kept for r in dedup.simhash_kept(signed).collect()} == want
    assert registry.QUERIES["simhash_dedup"](spark, SF).count() == 200
    assert dedup.dedup(docs_of(spark, []), "simhash").count() == 0


def test_links_of_signatures_are_counted_in_tiles(spark, monkeypatch):
    signed = signed_of(spark)
    want = {r.doc_id: (r["class"], r.n_links) for r in dedup.classes(signed, "simhash", dedup.simhash_edges(signed)).collect()}
    assert sum(n for _, n in want.values()) > 5000
    monkeypatch.setattr(dedup, "simhash_edges", None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        # Tiles that go on in further batches, and parts of a band.
        for most, batch in ((8192, 10_000), (7, 13), (1, 5)):
            monkeypatch.setattr(dedup, "TILE", most)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert {r.doc_id: (r["class"], r.n_links) for r in dedup.linked_classes(signed, "simhash", dedup.simhash_links(signed)).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert registry.QUERIES["simhash_pairs"](spark, SF).count() == 200


def test_entities_of_spans_are_looked_up(monkeypatch):
    rng = np.random.default_rng(2)

    def plain(es, a, b, most):
        meets = [k for k, e in enumerate(es) if e.end > a and e.start < b]
        anchor = meets[0] if meets else min(range(len(es)), key=lambda k: abs(es[k].start - a), default=None)
        group = [] if anchor is None else [k for k, e in enumerate(es) if e.parent == es[anchor].parent]
        before, after = [k for k in group if es[k].end <= a][-most:], [k for k in group if es[k].start >= b][:most]
        holds = sorted((e for e in es if e.start <= a and b <= e.end), key=lambda e: e.end - e.start)
        return meets, holds, [es[k].name for k in before + after]

    looked = 0
    for n in [0, 1, 2, *range(3, 60)]:
        starts = rng.integers(0, 60, n)
        es = [code.Entity(str(k), "f", "", int(s), int(s + rng.integers(1, 30 if k % 7 else 80)), parent=rng.choice([None, "x", "y"])) for k, s in enumerate(starts)]
        found = code.Found(es)
        for a, b, most in zip(rng.integers(-5, 90, 30).tolist(), rng.integers(1, 20, 30).tolist(), rng.integers(1, 4, 30).tolist()):
            meets, holds, near = plain(es, a, a + b, most)
            assert found.meeting(a, a + b) == meets and code.scope(found, a, a + b) == holds
            assert [s["name"] for s in code.siblings(found, a, a + b, most)] == near
            looked += len(meets)
    assert looked > 1000


def test_modules_are_parsed_in_pieces(monkeypatch):
    odd = "import os\n\n@wraps\ndef deco(a):\n    '''é\ndef no(): pass\n'''\n    return a\n\n\nclass A:\n    def f(self):\n        return 1\n\nx = '''\ndef neither(): pass\n'''\n"
    text = "".join(f"def part_{k}(count):\n    size = {k}\n    return size * count\n\n\n" for k in range(300)) + odd + "async def last(): pass\n" + "def after(): pass\n" * 9
    whole = code.parse(text, "python")
    parsed = []
    real = code.ast.parse
    monkeypatch.setattr(code.ast, "parse", lambda t, *a: parsed.append(len(t)) or real(t, *a))
    monkeypatch.setattr(code, "PIECE", 1000)
    assert code.parse(text[: text.index(odd)], "python")[0] == whole[0][:300] and max(parsed) < 2000 and len(parsed) > 10
    for piece in (1, 7, 50, 1000):
        monkeypatch.setattr(code, "PIECE", piece)
        assert code.parse(text, "python") == whole
        assert code.parse(text + "\n)(", "python")[3] == ["SyntaxError: unmatched ')' (<unknown>, line %d)" % (text.count("\n") + 2)]


def most_memory(path: str, text: str, limit: int) -> tuple[int, int]:
    """Rows of a document and bytes that were held at most while they were read one by one."""
    o = Options(max_chunk_size=limit, min_chunk_size=0, size_unit="chars")
    assert sum(len(r["text"]) for r in engine.chunks(path, text[:4000], o)) > 0
    gc.collect()
    tracemalloc.start()
    n = sum(1 for _ in engine.chunks(path, text, o))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, peak


def test_cells_hold_spans_and_no_rows():
    n, peak = most_memory("a.py", "".join(f"# %% [markdown]\nA note on part {k}, of a size.\n# %%\nkey = {k}\n" for k in range(3000)), 400)
    assert n == 6000 and peak < 500 * n


def test_json_members_hold_spans_and_no_rows():
    n, peak = most_memory("a.json", "{\n" + ",\n".join(f'  "part_{k}": {{"key": {k}, "part_{k}": []}}' for k in range(6000)) + "\n}\n", 60)
    assert n == 6000 and peak < 1000 * n
    for bad in ("[1]", "1", '{"a": }', "{"):
        assert [s for s, _ in markup.json_sections(bad)] == [(0, len(bad))]


def test_toml_tables_hold_spans_and_no_rows():
    n, peak = most_memory("a.toml", "".join(f'[parts.{k}]\nname = "part_{k}"\n' for k in range(6000)), 40)
    assert n == 6000 and peak < 1100 * n


def near_sets(spark):
    """Texts of 12 kinds with words left out, so that kinds have many pairs about the threshold."""
    rng = np.random.default_rng(4)
    kinds = [[f"w{k}_{i}" for i in range(40 + 20 * k)] for k in range(12)]
    texts = [" ".join(w for w in kinds[k % 12] if rng.random() > 0.06) for k in range(420)] + ["", "a", "a b"]
    return docs_of(spark, list(enumerate(texts)))


def plain_edges(signed):
    rows = [(r.doc_id, set(r.tokens), r.signature, r.digest) for r in signed.orderBy("doc_id").collect()]
    seen, least = set(), []
    for r in rows:
        if r[3] not in seen:
            seen.add(r[3])
            least.append(r)
    out = set()
    for i, (a, x, s, _) in enumerate(least):
        for b, y, t, _ in least[i + 1 :]:
            if any(s[k : k + 4] == t[k : k + 4] for k in range(0, 32, 4)) and len(x & y) * 10_000 >= len(x | y) * 8500:
                out.add((a, b))
    return out


def test_minhash_keeps_what_plain_pairs_keep(spark):
    rows = near_sets(spark)
    signed = dedup.minhash(rows)
    edges = plain_edges(signed)
    kept, classes = {}, {}
    for r in signed.orderBy("doc_id").collect():
        k, least = r.doc_id, classes.setdefault(r.digest, r.doc_id)
        before = [a for a in kept if kept[a] == a and (a, k) in edges]
        kept[k] = kept[least] if least < k else min(before) if before else k
    assert {r.doc_id: r.kept for r in dedup.dedup(rows, "minhash").collect()} == kept and 3 < len(set(kept.values())) < len(kept)
    # Pairs that no set of words could be: ruled out where they meet, and what is left goes with a number and not with words.
    found = dedup.minhash_candidates(signed)
    assert found.columns == ["a", "b", "meet"] and edges <= {(r.a, r.b) for r in found.collect()}


def test_sketches_are_parities_and_never_over_the_difference():
    rng = np.random.default_rng(8)
    sets = [sorted({f"w{x}" for x in rng.integers(0, 3000, n)}) for n in (0, 1, 5, 50, 400, 2000, 2000, 50, 49)] * 40
    got = signatures.parity(pa.array(sets, pa.list_(pa.string()))).to_pylist()
    for x, s in zip(sets, got):
        want = 0
        for w in x:
            want ^= 1 << int.from_bytes(hashlib.md5(w.encode()).digest()[4:8]) % signatures.SKETCH
        assert sum((v & (1 << 64) - 1).bit_count() for v in s) == want.bit_count() and len(s) == signatures.SKETCH // 64
    for i in range(9):
        for j in range(9):
            assert sum(((u ^ v) & (1 << 64) - 1).bit_count() for u, v in zip(got[i], got[j])) <= len(set(sets[i]) ^ set(sets[j]))


def test_pairs_of_sets_are_told_apart_where_they_meet(spark, monkeypatch):
    rows = near_sets(spark)
    signed = dedup.minhash(rows)
    want = plain_edges(signed)
    got = dedup.minhash_edges(signed)
    # No join brings two sets to a pair.
    assert "array_intersect" not in got._jdf.queryExecution().toString()
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 500
    texts = [" ".join(r.tokens) for r in signed.orderBy("doc_id").collect()]
    a, b = np.triu_indices(len(texts), 1)
    both = [signatures.alike(texts, a, b, 8500)]
    monkeypatch.setattr(signatures, "DENSE", 1 << 60)
    both.append(signatures.alike(texts, a, b, 8500))
    assert (both[0] == both[1]).all() and both[0].sum() >= len(want)
