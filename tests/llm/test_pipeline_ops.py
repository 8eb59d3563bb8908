"""The operators of the pipeline against brute force, round trips and held-out rows."""

import difflib
import hashlib
import itertools
import re
import sys
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kerf.llm import blocks, curriculum, decontaminate, neardup, quality, rangecoder, tokens, vec

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def words(rng, n, size=400):
    return [f"w{int(i)}x" for i in rng.integers(0, size, n)]


# 4:


def test_decision_list_is_right_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.expr("doc_id % 4 = 0")
    rules = quality.learn(docs, labels.where(~held))
    assert rules
    got = quality.judge(docs, rules).join(labels.where(held), "doc_id").toPandas()
    bad = got[got.quality == 0]
    assert (got[got.quality == 1].keep).mean() > 0.98
    assert (~bad.keep).mean() > 0.7


def test_case_expression_is_the_ordered_list(spark):
    c = quality.Condition
    rules = [(c("n_words", False, 3.0), c("n_chars", True, 5.0)), (c("symbol_share", True, 0.2),)]
    rows = [(1, "abcdef", None, None, 0), (2, "##a", None, None, 0), (3, None, "x", None, 0), (4, "", None, None, 0), (5, "###### b", None, None, 0), (None, "a b c d", None, None, 0)]
    got = {r.doc_id: r.rule for r in quality.judge(table(spark, rows), rules).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None, 5: 1, None: None}
    assert quality.expression([]) is not None
    kept = quality.keep(table(spark, rows).withColumn("n_words", F.lit("clash")), rules)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4] and "n_words" in kept.columns


def test_no_labels_keep_everything(spark):
    docs = table(spark, [(1, "a", None, None, 1)])
    assert quality.learn(docs, spark.createDataFrame([], "doc_id bigint, quality int")) == []
    assert quality.keep(docs, []).count() == 1
    assert quality.keep(table(spark, []), []).count() == 0


def test_covering_finds_planted_conjunction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(quality.FEATURES)))
    good = ~((x[:, 2] < 0.3) & (x[:, 5] >= 0.6))
    rules = quality.fit(x, good.astype(int))
    found = np.zeros(3000, bool)
    for r in rules:
        found |= quality.covers(r, x)
    assert (found == ~good).mean() > 0.97


# 9:


def test_golay_decoding_is_perfect_and_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    u = rng.integers(0, 1 << 23, 3000).astype(np.int32)
    code = neardup.decode(u)
    assert len(np.unique(neardup.decode(np.arange(1 << 23, dtype=np.int32)), return_counts=True)[1]) == 4096
    for k in (1, 2):
        v = u.copy()
        for i in range(len(v)):
            for b in rng.choice(23, k, replace=False):
                v[i] ^= 1 << int(b)
        (a, x), (b, y) = neardup.fuzzy_keys(u), neardup.fuzzy_keys(v)
        assert ((a[:, :, None] == b[:, None, :]) & x[:, :, None] & y[:, None, :]).any((1, 2)).all()
    assert code.max() < 4096


def _brute_pairs(rows):
    f = np.array([[r.f0, r.f1, r.f2] for r in rows], np.int64).view(np.uint8)
    bits = np.unpackbits(f, axis=1).astype(np.float32) * 2 - 1
    near = (neardup.BITS - bits @ bits.T) / 2 <= neardup.MAX_DISTANCE
    return {(min(a.id, b.id), max(a.id, b.id)) for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2) if near[i, j]}


def test_search_has_the_recall_it_claims(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(120):
        base = words(rng, int(rng.integers(40, 300)), 5000)
        for c in range(3):
            w = list(base)
            for _ in range(max(1, len(w) * c // 50)):
                w[int(rng.integers(len(w)))] = f"edit{int(rng.integers(9999))}"
            rows.append((3 * g + c, " ".join(w), "en", "s", 0))
    found = neardup.texts(table(spark, rows)).withColumnRenamed("doc_id", "id").select("id", "f0", "f1", "f2")
    got = {(r.a, r.b) for r in neardup.similar_pairs(found).collect()}
    true = _brute_pairs(found.collect())
    assert got <= true and len(got) >= 0.9 * len(true) and len(true) > 200


def test_pairs_within_eight_bits_over_segments_are_found_whatever_the_rest(spark):
    rng = np.random.default_rng(12)
    rows, want = [], set()
    for k in range(300):
        f = rng.integers(0, 1 << 63, 3).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 3).astype(np.uint64)
        g = f.copy()
        inner = rng.choice(92, 8, replace=False)
        outer = 92 + (100 - 1 - np.arange(20)) if k % 2 else 92 + rng.choice(100, 20, replace=False)
        for b in [*inner, *outer]:
            g[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows += [(2 * k, *f.view(np.int64).tolist()), (2 * k + 1, *g.view(np.int64).tolist())]
        want.add((2 * k, 2 * k + 1))
    found = {(r.a, r.b): r.distance for r in neardup.similar_pairs(spark.createDataFrame(rows, "id bigint, f0 bigint, f1 bigint, f2 bigint")).collect()}
    assert want <= set(found) and all(found[p] == 28 for p in want)


def test_fingerprint_is_the_weighted_sign_sum():
    col = pa.array(["Alpha beta beta gammadelta", "", None, "x " * 50000 + "y"])
    got, n = neardup.fingerprints(col)
    assert n.tolist() == [3, 0, 0, 2]
    h = [x for x in vec.word_hashes(["alpha", "beta", "gammadelta"])]
    total = np.zeros(neardup.BITS)
    for x, size in zip(h, (5, 4, 10)):
        key = (x[0] >> np.uint64(26) << np.uint64(4)) | np.uint64(size)
        parts = [vec.mix(np.array([key * np.uint64(2 * k + 3) + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (2**64 - 1))])) for k in range(3)]
        bits = np.unpackbits(np.concatenate(parts).view(np.uint8))
        total += np.where(bits, size, -size)
    assert (np.unpackbits(got[0].view(np.uint8)) == (total >= 0)).all()


def test_groups_nulls_and_repeated_rows(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(5, long, "en", "a", 1), (9, long + " end", "en", "b", 1), (7, long.upper(), None, None, None), (1, "", "en", "a", 0), (2, "", "en", "a", 0), (3, None, "en", "a", 0), (None, long, "en", "a", 0), (11, "###", "en", "a", 3), (12, "###", "en", "a", 3), (12, "###", "en", "a", 3), (20, "quite another text", "en", "a", 3)]
    docs = table(spark, rows).withColumn("root", F.lit("clash"))
    got = {r.doc_id: r.kept_doc_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {7: 5, 9: 5, 12: 11}
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 11, 20]
    assert neardup.near_duplicates(table(spark, [])).count() == 0


def test_components_of_chains_and_cliques(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(50, 90)] + [(int(a), int(b)) for a, b in rng.integers(100, 300, (150, 2)) if a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    expected = {x: find(x) for x in list(parent) if find(x) != x}
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == expected


# 10:


def test_every_accepted_overlap_that_a_mask_can_hit_is_found(spark):
    rng = np.random.default_rng(5)
    items = [(i, " ".join(words(rng, 40, 3000))) for i in range(12)] + [(50, "only four tokens here"), (51, ""), (52, None), (53, "One two three four five six seven")]
    rows = []
    for k in range(80):
        w = words(rng, 200, 3000)
        if k % 2:
            cut = items[k % 12][1].split()[: int(rng.integers(15, 41))]
            for _ in range(k % 4):
                cut[int(rng.integers(len(cut)))] = "substituted"
            at = int(rng.integers(0, 200))
            w[at:at] = cut
        rows.append((k, " ".join(w).title() + ".", "en", "s", 0))
    rows += [(100, "x one, two THREE four five six seven! y", "en", "s", 0), (101, None, None, None, None), (102, "", "en", "s", 0), (103, "say only four tokens here", "en", "s", 0), (None, items[0][1], "en", "s", 0)]
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert got == {tuple(r) for r in decontaminate.find_overlaps(docs, bench, 0).collect()}
    brute = set()
    hashed = dict(zip([i for i, _ in items], vec.word_hashes([t for _, t in items])))
    for (d, *_), h in zip(rows, vec.word_hashes([r[1] for r in rows])):
        for i, x in hashed.items():
            all_ = [f for g in range(-len(x), len(h)) if (f := decontaminate.overlap(h, x, g)) and decontaminate.accepted(f, len(x))]
            if all_:
                brute.add((d, i))
    found = {g[:2] for g in got}
    assert found <= brute and len(found) >= 0.97 * len(brute) and {(100, 53), (103, 50), (None, 0)} <= found
    kept = decontaminate.decontaminate(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in found}


def test_no_benchmark_and_no_documents(spark):
    docs, bench = table(spark, [(1, "a b", None, None, 0)]), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_overlaps(docs, bench).count() == 0
    assert decontaminate.decontaminate(table(spark, []), bench).count() == 0


def test_rows_are_judged_each_and_null_items_on_both_paths(spark):
    leak = " ".join(f"secret{i}" for i in range(20))
    rows = [(None, leak, "en", "s", 0), (None, "a clean text", "en", "s", 0), (7, leak + " more", "en", "s", 0), (7, "another clean text", "en", "s", 0), (8, None, "en", "s", 0)]
    docs, bench = table(spark, rows), spark.createDataFrame([(None, leak), (1, leak)], "item_id bigint, text string")
    for limit in (decontaminate.BROADCAST_HASHES, 0):
        kept = sorted((r.doc_id or 0, r.text) for r in decontaminate.decontaminate(docs, bench, limit).collect())
        assert kept == [(0, "a clean text"), (7, "another clean text"), (8, None)]
        found = sorted((r.doc_id or 0, r.item_id or 0) for r in decontaminate.find_overlaps(docs, bench, limit).collect())
        assert found == [(0, 0), (0, 1), (7, 0), (7, 1)]


def test_altered_copies_of_short_items_are_found_as_on_all_diagonals(spark):
    items, rows = [], []
    for n in range(4, 11):
        own = [f"i{n}t{k}" for k in range(n)]
        items.append((n, " ".join(own)))
        for size in (0, 1, 2, 3):
            for out in itertools.combinations(range(n), size):
                altered = " ".join("other" if k in out else w for k, w in enumerate(own))
                rows.append((len(rows), f"before {altered} after", "en", "s", 0))
                rows.append((len(rows), " ".join(w for k, w in enumerate(own) if not (k in out and k in (0, 1, n - 2, n - 1))), "en", "s", 0))
    h = dict(zip([i for i, _ in items], vec.word_hashes([t for _, t in items])))
    true = set()
    for (d, *_), x in zip(rows, vec.word_hashes([r[1] for r in rows])):
        true |= {(d, i) for i, y in h.items() for g in range(-len(y), len(x)) if (f := decontaminate.overlap(x, y, g)) and decontaminate.accepted(f, len(y))}
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (decontaminate.BROADCAST_HASHES, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, bench, limit).collect()} == true


# 6:


def test_positions_match_sql_on_odd_rows(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), "en", f"s{i % 3}" if i % 11 else None, 0) for i in range(200)] + [(None, "a b", None, "s1", 0), (7, "again", None, "s1", 0), (7, "again", None, "s1", 0), (300, None, None, "lonely", 0)]
    docs = table(spark, rows)
    con = duckdb.connect()
    pdf = docs.toPandas()
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    con.register("documents", pa.Table.from_pandas(pdf))
    expected = sorted(con.execute(curriculum.DEFAULT_SQL).fetchall(), key=repr)
    got = sorted((tuple(r) for r in curriculum.positions(docs).collect()), key=repr)
    assert got == expected
    assert curriculum.positions(table(spark, [])).count() == 0
    assert curriculum.mix(docs.withColumn("before", F.lit(1))).columns == [*docs.columns, "before"]


def test_target_positions_match_sql(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), "en", f"src{i % 4}" if i % 11 else None, 0) for i in range(300)] + [(None, "a b", None, "src1", 0), (7, "again", None, "src1", 0), (301, None, None, "lonely", 0)]
    docs = table(spark, rows)
    for schedules in (curriculum.TARGETS, {None: [(0, 1)], "src2": [(0.25, 0), (0.5, 3)], "it's": [(0, 1)]}):
        con = duckdb.connect()
        pdf = docs.toPandas()
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        con.register("documents", pa.Table.from_pandas(pdf))
        expected = sorted(con.execute(curriculum.sql(schedules)).fetchall(), key=repr)
        assert sorted((tuple(r) for r in curriculum.positions(docs, schedules).collect()), key=repr) == expected


def test_schedules_are_inverted(spark):
    rows = [(i, "t " * 10, "en", "ab"[i % 2], 0) for i in range(2000)]
    got = curriculum.positions(table(spark, rows), {"a": [(0, 2), (1, 0)], "b": [(0, 0), (1, 2)]}).toPandas()
    a, b = got[got.source == "a"].position, got[got.source == "b"].position
    for t in (0.25, 0.5, 0.75):
        assert abs((a < t).mean() - (2 * t - t * t)) < 0.002 and abs((b < t).mean() - t * t) < 0.002
    short = curriculum.positions(table(spark, rows), {"a": [(0, 1)], "c": [(0, 1)]}, 500).toPandas()
    assert short.position.notna().sum() == 50 and short[short.source == "b"].position.isna().all()
    with pytest.raises(ValueError):
        curriculum.positions(table(spark, rows), {"a": [(0, -1)]})


# 5:


def test_ids_are_the_tokenizers_own():
    texts = ["Hello  world\n\nfoo\tbar's", "", None, "  lead", "a  b  c", "x\ny z  \n w", "né à 12,5 €", "trail ", "\n", "it's 3 o'clock\r\nnow"]
    codec = tokens.codec()
    for _ in range(2):
        ids, ends = codec.encode(pa.array(texts))
        for t, a, b in zip(texts, ends, ends[1:]):
            assert ids[a:b].tolist() == [*codec.encoding.encode_ordinary(t or ""), codec.eot]


def test_ids_next_to_white_space_of_several_bytes_are_the_tokenizers_own():
    # A white-space character beside one of several bytes doesn't stand alone; separators such as U+001C are none.
    texts = ["a\u3000 \u3000b", "x\u3000 y", " \u3000y", "x \u00a0y z\u0085", "q\u2003 w", "!\x1c!", "!\x1f ?", "\u4e00\u3000\u4e01 \u00e9\u00a9"]
    rng, parts = np.random.default_rng(6), [" ", "  ", "\n", "a", "bc", "12", "!", "\u3000", "\u2003", "\u00a0", "\u0085", "\x1c", "\u00e9", "\u6f22"]
    texts += [" \u2003", " \u0085", *("".join(rng.choice(parts, 30)) for _ in range(400))]
    codec = tokens.Codec(*tokens.codec().made)
    for some in (texts, texts[::-1], [t + " " + u for t, u in zip(texts, texts[5:])]):
        ids, ends = codec.encode(pa.array(some))
        for t, a, b in zip(some, ends, ends[1:]):
            assert ids[a:b].tolist() == [*codec.encoding.encode_ordinary(t), codec.eot], t
            assert codec.decode(ids[a:b]) == t


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    # Two stretches that differ in bytes 4096 apart, as such and with a hash that knows lengths only.
    texts = ["p" + "x" * 4095 + "q" + "yz", "q" + "x" * 4095 + "p" + "yz", "one two", "six two", "two one"]
    plain = vec.hash_runs(*[np.frombuffer("".join(texts[:2]).encode(), np.uint8), np.array([4099, 4099])])
    assert plain[0] != plain[1]
    for hashes in (vec.hash_runs, lambda raw, lengths: lengths.astype(np.uint64)):
        monkeypatch.setattr(vec, "hash_runs", hashes)
        codec = tokens.Codec(*tokens.codec().made)
        for _ in range(2):
            ids, ends = codec.encode(pa.array(texts))
            assert [codec.decode(ids[a:b]) for a, b in zip(ends, ends[1:])] == texts


def test_equal_hashes_of_short_stretches_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "_hash", lambda heads, lengths: lengths.astype(np.uint64))
    codec = tokens.Codec(*tokens.codec().made)
    texts = ["one two six one", "two one\x00 one ten", "ten eightletters sevenletters", "é ë é six", " a long stretch_of_over_16_bytes stretch_of_over_16_bytez"]
    for _ in range(2):
        ids, ends = codec.encode(pa.array(texts))
        assert [codec.decode(ids[a:b]) for a, b in zip(ends, ends[1:])] == texts


def test_new_stretches_take_no_python_calls_of_their_own():
    codec = tokens.Codec(*tokens.codec().made)
    text = pa.array([" ".join(f"{i:x}" for i in range(5000))])
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        ids, _ = codec.encode(text)
    finally:
        sys.setprofile(None)
    assert codec.decode(ids) == text[0].as_py()
    assert calls < 1000, "5000 stretches that weren't met before"


def test_smaller_bytes_are_counted_in_groups_of_all_sizes():
    rng = np.random.default_rng(8)
    sizes = np.array([3, 0, 128, 1, 129, 65535, 256, 40_000, 2, 5000])
    byte = (rng.zipf(1.2, sizes.sum()) % 256).astype(np.uint8)
    got, to = rangecoder._below(byte, sizes), 0
    for n in sizes:
        part, to = byte[to : to + n], to + n
        counts = np.cumsum(np.arange(256)[:, None] == part, axis=1, dtype=np.int32)
        below = np.cumsum(counts, axis=0)
        want = [below[b - 1, i] if b else 0 for i, b in enumerate(part.tolist())]
        assert got[to - n : to].tolist() == want


def _scalar_stream(ids):
    """The coder again, one id at a time, with dictionaries and one long integer."""
    import collections
    import math

    log = [0] + [round(256 * math.log(i)) for i in range(1, 2 * len(ids) + 3)]
    squash = [max(64, min(65472, round(65536 / (1 + math.exp(-i / 256))))) for i in range(-2048, 2048)]
    memo, tried, hits = ({}, {}), collections.Counter(), collections.Counter()
    weight, slope = {(o, k): 40000 for o in (0, 1) for k in (0, 1)}, collections.Counter()
    frequency, first, second = collections.Counter(), [0] * 256, collections.defaultdict(lambda: [0] * 256)
    low, width, shifted, older, last = 0, 1 << 62, 0, 0, 0

    def narrow(start, size, bits):
        nonlocal low, width
        width >>= bits
        low += width * start
        width *= size

    def byte(counts, b):
        total = 256 + 40 * sum(counts)
        edges = [(n + 40 * sum(counts[:n])) * (32768 - 256) // total + n for n in (b, b + 1)]
        counts[b] += 1
        return edges[0], edges[1] - edges[0]

    for t, x in enumerate(ids):
        if t and t % 256 == 0:
            for k in weight:
                weight[k] = max(-200_000, min(200_000, weight[k] + (slope[k] >> 14)))
            slope.clear()
        slots = ((older * 0x9E3779B1 + last * 0x85EBCA6B) % (1 << 32) >> 16, last)
        (g2, s2, b2), (g1, s1, b1) = (memo[o].get(slots[o], (-1, 0, 0)) for o in (0, 1))
        there = (g2 >= 0, g1 >= 0 and g1 != g2)
        states = [(s2 * 16 + s1 * 2 + (g1 == g2), b2 * 4 + min(s2, 3)), (s2 * 16 + s1 * 2 + (g1 == g2), b1 * 4 + min(s1, 3))]
        odds, p = {}, [0, 0]
        for o in (0, 1):
            for k in (0, 1):
                h, n = hits[o, k, states[o][k]], tried[o, k, states[o][k]]
                odds[o, k] = max(-2047, min(2047, log[2 * h + 1] - log[2 * (n - h) + 1]))
            p[o] = squash[max(-2047, min(2047, sum(weight[o, k] * odds[o, k] for k in (0, 1)) >> 16)) + 2048]
        w2 = p[0] if there[0] else 0
        w1 = max(1, (65536 - w2) * p[1] >> 16) if there[1] else 0
        kind = 0 if there[0] and g2 == x else 1 if there[1] and g1 == x else 2
        narrow(*((0, w2), (w2, w1), (w2 + w1, 65536 - w2 - w1))[kind], 16)
        high = x >> 8
        for start, size in ((0, 32768), (0, 32768)) if kind < 2 else (byte(first, high), byte(second[high], x & 255)):
            narrow(start, size, 15)
        while width < 1 << 46:
            low, width, shifted = low << 16, width << 16, shifted + 1
        for o, judged in ((0, there[0]), (1, there[1] and kind != 0)):
            for k in (0, 1) if judged else ():
                right = (g2, g1)[o] == x
                slope[o, k] += odds[o, k] * ((right * 65535 - p[o]) >> 4)
                tried[o, k, states[o][k]] += 1
                hits[o, k, states[o][k]] += right
        for o, (g, s) in enumerate(((g2, s2), (g1, s1))):
            memo[o][slots[o]] = (x, min(s + 1, 7) if g == x else 0, min(7, frequency[x].bit_length()))
        frequency[x] += 1
        older, last = last, x
    return (low << 2).to_bytes(2 * (shifted + 4), "big")


def test_streams_are_those_of_a_scalar_coder():
    rng = np.random.default_rng(11)
    made = [rng.integers(0, 50257, 200), np.zeros(700), rng.integers(0, 3, 900), rng.zipf(1.3, 1500) % 50000, np.tile(rng.integers(0, 65536, 60), 12), np.array([65535, 0])]
    made = [m.astype(np.uint16) for m in made]
    for ids, stream in zip(made, rangecoder.encode_blocks(made)):
        assert _scalar_stream(ids.tolist()) == stream


def test_streams_round_trip():
    rng = np.random.default_rng(4)
    made = [rng.integers(0, 50257, 300), np.zeros(3000), np.arange(1500), rng.integers(0, 3, 2500), rng.zipf(1.3, 2000) % 50000, np.array([65535, 0]), np.zeros(0)]
    made = [m.astype(np.uint16) for m in made]
    streams = rangecoder.encode_blocks(made)
    back = rangecoder.decode_blocks(streams, [len(m) for m in made], [rangecoder.checksum(m, s) for m, s in zip(made, streams)])
    assert all((a == b).all() for a, b in zip(made, back))
    assert rangecoder.encode_blocks(made[2:3]) == streams[2:3], "a block's stream doesn't depend on its neighbours"
    assert len(streams[1]) < 60
    bad = bytearray(streams[0])
    bad[10] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode_blocks([bytes(bad)], [300], [rangecoder.checksum(made[0], streams[0])])


def test_documents_come_back_from_blocks(spark):
    rows = [(i, f"document {i} " * (i % 50), "en", "s", 0) for i in range(120)] + [(200, None, None, None, None), (201, "", "", "", 0), (202, "long " * 5000, "en", "s", 0), (None, "no id", "", "", 0)]
    docs = table(spark, rows).repartition(3)
    written = blocks.write_blocks(docs, block=256, lanes=8)
    got = {}
    for r in blocks.read_blocks(written).collect():
        got.setdefault(r.doc_id, []).append((r.part_start, r.ids))
    for i, text, *_ in rows:
        parts = sorted(got[i])
        assert [p for p, _ in parts] == np.cumsum([0, *(len(x) for _, x in parts)])[:-1].tolist()
        assert tokens.codec().decode([k for _, x in parts for k in x]) == (text or "")
    assert blocks.write_blocks(table(spark, [])).count() == 0


# the pipeline:


def _statistics(text):
    """The statistics of quality rules, sign by sign."""
    t = text or ""
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
    lines = [x for x in re.split(r"[ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*", t) if x]
    n = len(t)
    return {
        "n_chars": n, "n_words": len(w), "word_chars": (n - len(w) + 1) / len(w) if w else 0, "upper_share": sum(unicodedata.category(c) == "Lu" for c in t) / n if n else 0,
        "symbol_share": sum(c in "#$%&*|!<>{}=~^_\\@+" for c in t) / n if n else 0, "digit_share": sum(c in "0123456789" for c in t) / n if n else 0, "distinct_share": len(set(w)) / len(w) if w else 0,
        "repeated_lines": (len(lines) - len(set(lines))) / len(lines) if lines else 0, "longest_word": max(map(len, w), default=0),
    }


def _rejecting(rules, text):
    x = _statistics(text)
    return next((k for k, rule in enumerate(rules, 1) if all(x[c.feature] >= c.threshold if c.above else x[c.feature] < c.threshold for c in rule)), None)


def test_rules_are_those_of_plain_statistics(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality.learn(docs, labels)
    odd = table(spark, [(-1, None, "", "", 0), (-2, "", "", "", 0), (-3, "ÄÖ ###\n\nx\nx\n" * 3, "", "", 0), (-4, "word " * 30000, "", "", 0)])
    every = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    text = {r.doc_id: r.text for r in every.collect()}
    assert {r.doc_id: r.rule for r in quality.judge(every, rules).collect()} == {d: _rejecting(rules, t) for d, t in text.items()}


def _demand(schedule, t):
    """The integral of a schedule from 0 to t, piece by piece."""
    knots = [(0.0, schedule[0][1]), *[k for k in schedule if 0 < k[0] < 1], (1.0, schedule[-1][1])]
    total = 0.0
    for (a, u), (b, v) in zip(knots, knots[1:]):
        e = min(max(t, a), b)
        w = u + (v - u) * (e - a) / (b - a)
        total += (u + w) / 2 * (e - a)
    return total


def _plain_positions(rows):
    """doc_id -> position by halving intervals, for documents of different ids."""
    by_source = {}
    for d, text, source in rows:
        by_source.setdefault(source, []).append((hashlib.md5(str(d).encode()).hexdigest(), d, len((text or "").split())))
    budget = min(sum(n for *_, n in x) / _demand(curriculum.TARGETS[s], 1) for s, x in by_source.items() if s in curriculum.TARGETS)
    out = {}
    for s, x in by_source.items():
        before = 0
        for _, d, n in sorted(x):
            goal, before = (before + n / 2) / budget, before + n
            if s not in curriculum.TARGETS or goal >= _demand(curriculum.TARGETS[s], 1):
                out[d] = None
                continue
            lo, hi = 0.0, 1.0
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if _demand(curriculum.TARGETS[s], mid) < goal else (lo, mid)
            out[d] = hi
    return out


def test_stages_are_their_brute_force_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, sf_dir).cache()
        assert seen.columns == docs.columns
        got = [r.doc_id for r in seen.select("doc_id").collect()]
        if name == "quality rules":
            assert sorted(got) == sorted(d for d, t, _ in rows if _rejecting(rules, t) is None)
        elif name == "SimHash near-dedup":
            f, n = neardup.fingerprints(pa.array([t for _, t, _ in rows], pa.string()))
            bits = np.unpackbits(f.view(np.uint8), axis=1).astype(np.int32)
            parent = list(range(len(rows)))

            def find(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for i, j in itertools.combinations(range(len(rows)), 2):
                if rows[i][1] and (rows[i][1] == rows[j][1] or (n[i] and n[j] and (bits[i] != bits[j]).sum() <= neardup.MAX_DISTANCE)):
                    a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                    parent[b] = a
            kept = {rows[i][0] for i in range(len(rows)) if find(i) == i}
            assert kept <= set(got) and len(set(got) - kept) <= 0.05 * (len(rows) - len(kept))
        elif name == "benchmark decontamination":
            items = vec.word_hashes([t for _, t in bench])
            # Diagonals without an equal token have no overlap.
            diagonals = lambda h, x: {int(i - j) for j, y in enumerate(x) for i in np.flatnonzero(h == y)}
            clean = [d for (d, _, _), h in zip(rows, vec.word_hashes([t for _, t, _ in rows])) if not any((o := decontaminate.overlap(h, x, g)) and decontaminate.accepted(o, len(x)) for x in items if np.isin(x, h).sum() > 3 for g in diagonals(h, x))]
            assert set(clean) <= set(got) and len(got) - len(clean) <= 0.05 * (len(rows) - len(clean) + 1)
        else:
            place = _plain_positions(rows)
            assert sorted(got) == sorted(place)
            at = [place[d] for d in got]
            with_place = [x for x in at if x is not None]
            assert at[: len(with_place)] == with_place and all(b >= a - 1e-9 for a, b in zip(with_place, with_place[1:])) and len(with_place) < len(at)
        rows = [x for x in rows if x[0] in set(got)]
    text = {d: t for d, t, _ in rows}
    parts = {}
    for r in blocks.read_blocks(corpus_pipeline.STAGES[-1][1](spark, seen, sf_dir)).collect():
        parts.setdefault(r.doc_id, []).append((r.part_start, r.ids))
    assert {d: tokens.codec().decode([k for _, x in sorted(p) for k in x]) for d, p in parts.items()} == text


def test_stages_take_odd_tables(spark, sf_dir):
    names = ("__stats", "__t", "__w", "__l", "__at", "__id", "__copy", "__leak", "position", "n_tokens")
    long = " ".join(f"word{i}" for i in range(4000))
    rows = [(None, None, None, None, None), (None, "text without an id, of which there is one only", "en", "src1", 9), (1, "", "en", "src0", 0), (2, long, "en", "src0", 1), (2, long, "en", "src0", 1), (3, long, "en", None, 1), (4, "one more text, unlike the others here", None, "elsewhere", 5)]
    docs = table(spark, rows)
    for k in names:
        docs = docs.withColumn(k, F.lit("clash"))
    for df, n in ((docs, 5), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            df = stage(spark, df, sf_dir).cache()
            assert df.columns == docs.columns and df.count() == (6 if n and name != "quality rules" else n), name
        assert (corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() > 0) == bool(n)
        assert corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).columns == docs.columns
    assert {r.doc_id for r in quality.judge(docs, []).collect()} == {None, 1, 2, 3, 4}
