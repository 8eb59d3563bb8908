"""Toxicity of deobfuscated text: a noisy channel over character lattices.

Writers hide words by leetspeak, by spacing and by repetition.  A token that holds any sign of
that is a lattice: each run of equal characters offers the letters that it may stand for (once or
twice), itself, or nothing.  Viterbi decoding finds the text that is most probable under the channel and a
character trigram model of the whole corpus, in part interpolated with the learned stems; the restored text is what is scored.

Stems are learned from labelled documents: prefixes of words, or whole words (with a space at their end), that are many times
as frequent in toxic documents as in others.  A document's score is the sum over its different restored words of the log ratio of
their stem's rates in toxic and other documents; the threshold is the one that errs least on the labelled documents.
A word counts once in a document, so that repeated lines say no more than one.

A word may begin at any place in a token that no letter is before, and a spaced word is a row of short pieces (three
different neighbours at most), whose gaps are part of the lattice.  Lattices are decoded only where some path through them begins with a
stem: a trie of the stems is walked over all options of each run at once, in time linear in the token's length, and what is decoded
is that stretch and up to CONTEXT runs behind it.  No other path can change a score.

Defined cases: null and empty texts score 0 and aren't toxic; without toxic labels there are no stems and all scores are 0;
labels that are null or of unknown documents are ignored, and of several labels of a document the highest counts;
repeated rows get equal scores; extra columns are ignored; empty tables give none; texts are scored whole.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from kerf.llm import chars, vec

#: Labelled rows that stems are learned from at most, those of least hash; half of them toxic where there are as many.
MAX_LABELLED = 20_000
MIN_RATIO, MIN_STEM, MAX_STEM = 8.0, 3, 16
#: Runs behind a stem that its decoding looks at, and letters of a piece of a spaced word.
CONTEXT, PIECE = 32, 3
#: Nats by which a stem's toxic share must be surprising: chance at most e**-20 for one prefix, of millions tried.
MIN_EVIDENCE = 20.0
#: Words by which a toxic document is explained.
ENOUGH = 3
MIN_THRESHOLD = 3.0
LEXICON_SHARE = 0.3

LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i",
}
#: Signs that are put between letters and mean nothing.
NOISE = ".,-_*~'`^#%&/\\:;=\"?)[]{}<>"
#: Logs of the channel. Leaving out a sign that may be a letter costs about what the letter would in the language model.
_SUBSTITUTE, _DROP, _DROP_LEET, _LITERAL, _ONCE_OF_2, _ONCE, _TWICE = -0.7, -0.8, -6.0, -2.5, -1.5, -0.4, -1.0
#: A gap between pieces that isn't one, beside a piece of several letters.
_JOIN = -4.0
_EDGE = NOISE + "!|"
_BY_LETTER: dict[str, str] = {}
for _s, _letters in LEET.items():
    for _l in _letters:
        _BY_LETTER[_l] = _BY_LETTER.get(_l, "") + _s
_STRIP = _EDGE + "0123456789@$+ "
_RUNS = re.compile(r"(.)\1*", re.S)
_DOUBLE = re.compile(r"(.)\1", re.S)
_LONG_RUN = re.compile(r"(.)\1\1", re.S)


def letter_codes(text: str) -> list[int]:
    """Character codes of the language model, one for each character."""
    raw, offsets = vec.buffers(pa.array(list(text), pa.string()))
    return chars.codes(raw, offsets)[0].tolist()


_CODE: dict[str, int] = {}


def _code(c: str) -> int:
    if c not in _CODE:
        _CODE[c] = letter_codes(c)[0]
    return _CODE[c]


def language_model(grams: np.ndarray, counts: np.ndarray, words: dict[str, float]) -> np.ndarray:
    """Natural logs of P(c | a, b) as a SIZE x SIZE x SIZE array: interpolated orders of the corpus, mixed with the stems' own trigrams."""
    size = chars.SIZE
    corpus = np.zeros(size**3)
    corpus[np.asarray(grams, np.int64)] = counts
    own = np.zeros(size**3)
    for word, weight in words.items():
        c = [0, 0, *letter_codes(word.rstrip() + " ")]
        for a, b, d in zip(c, c[1:], c[2:]):
            own[(a * size + b) * size + d] += weight

    def smooth(total: np.ndarray) -> np.ndarray:
        three = total.reshape(size, size, size)
        two, one = three.sum(0), three.sum((0, 1))
        p = (one + 0.5) / (one.sum() + 0.5 * size)
        p = (two + 20 * p) / (two.sum(1, keepdims=True) + 20)
        return (three + 20 * p[None]) / (three.sum(2, keepdims=True) + 20)

    share = LEXICON_SHARE if words else 0.0
    return np.log((1 - share) * smooth(corpus) + share * smooth(own)).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters: what it may stand for, with log probabilities of the channel."""
    out = []
    for m in _RUNS.finditer(token):
        run, c = m.group(), m.group(1)
        n = len(run)
        if c in LEET:
            # At the end of a token an exclamation mark is most often just that.
            options = [("", _DROP if m.end() == len(token) and c in "!|+" else _DROP_LEET), (run if n < 3 else c, _LITERAL)]
            for letter in LEET[c]:
                options += [(letter, _SUBSTITUTE)] if n == 1 else [(letter, _SUBSTITUTE + _ONCE), (letter * 2, _SUBSTITUTE + _TWICE)]
        elif c in NOISE or c.isspace():
            options = [("", _DROP), (c, _LITERAL)]
        elif n == 1:
            options = [(c, 0.0)]
        elif n == 2:
            options = [(run, 0.0), (c, _ONCE_OF_2)]
        else:
            options = [(c, _ONCE), (c * 2, _TWICE)]
        out.append(options)
    return out


Lattice = list[list[tuple[str, float]]]


def decode(steps: str | Lattice, logs: np.ndarray) -> tuple[str, float]:
    """The most probable text of a token or lattice, and its log probability; the state is the last two characters."""
    # A path is its last piece of text and the path before it.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(steps) if isinstance(steps, str) else steps:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (p, path) in states.items():
            for emit, cost in options:
                x, y, q = a, b, p + cost
                for c in emit:
                    k = _code(c)
                    q += float(logs[x, y, k])
                    x, y = y, k
                if (x, y) not in after or q > after[x, y][0]:
                    after[x, y] = (q, (emit, path) if emit else path)
        states = after
    best, path = max(((p + float(logs[a, b, 0]), path) for (a, b), (p, path) in states.items()), key=lambda x: x[0], default=(0.0, None))
    text = []
    while path is not None:
        text.append(path[0])
        path = path[1]
    return "".join(reversed(text)), best


@dataclass
class Scorer:
    """Stems with their evidence in nats, and the language model."""

    stems: dict[str, float]
    logs: np.ndarray
    threshold: float = MIN_THRESHOLD

    def __post_init__(self):
        self.lengths = sorted({len(s) for s in self.stems})
        self.trie: dict = {}
        for stem in self.stems:
            node = self.trie
            for c in stem:
                node = node.setdefault(c, {})
            node["end"] = True
        # A stem's letters or their signs must occur in order. Each step of a pattern stops at the first sign that fits and
        # never goes back, so a pattern takes one pass.
        parts = []
        for stem in sorted({_RUNS.sub(r"\1", x.rstrip()) for x in self.stems}):
            fit = [re.escape(c + _BY_LETTER.get(c, "")) for c in stem]
            parts.append("".join(f"[^{x}]*+[{x}]" for x in fit))
        self.patterns = [re.compile(p, re.S) for p in parts]
        self.cache, self.spaced = _Cache(self.known), _Cache(self.joined)

    def stem(self, word: str) -> str | None:
        word += " "
        for n in self.lengths:
            if word[:n] in self.stems:
                return word[:n]
        return None

    def possible(self, text: str) -> bool:
        return any(p.match(text) for p in self.patterns)

    def scan(self, steps: Lattice, begins: list[bool], gaps: list[int] | None = None) -> list[tuple[str, str]]:
        """(stem, restored text) of each stretch that, decoded, begins with a stem; stretches don't overlap.

        ``begins`` says where words may begin. With ``gaps``, the number of gaps before each run, only stretches over a gap count.
        """
        hits: list[tuple[str, str]] = []
        failed: set[int] = set()
        # Places in the trie, by the node's identity: (node, where its word begins, the latest of several).
        active: dict[int, tuple[dict, int]] = {}
        n = len(steps)
        for i in range(n + 1):
            options = steps[i] if i < n else [(" ", 0.0)]
            if i < n and begins[i]:
                active[id(self.trie)] = (self.trie, i)
            after: dict[int, tuple[dict, int]] = {}
            found = -1
            for node, start in active.values():
                if start in failed:
                    continue
                for emit, _ in options:
                    to = node
                    for c in emit if emit.isalnum() or not emit else " ":
                        to = to.get(c)
                        if to is None:
                            break
                        if "end" in to and (gaps is None or gaps[min(i, n - 1)] > gaps[start]):
                            found = max(found, start)
                    if to is not None and to is not self.trie and (id(to) not in after or after[id(to)][1] < start):
                        after[id(to)] = (to, start)
            active = after
            if found >= 0:
                restored = decode(steps[found : i + 1 + CONTEXT], self.logs)[0].strip(_STRIP)
                stem = self.stem(restored)
                if stem:
                    hits.append((stem, restored))
                    active = {}
                else:
                    failed.add(found)
        return hits

    def known(self, token: str) -> tuple[tuple[str, str], ...] | None:
        """The hits of a token; for a short piece without any, _SHORT; else None."""
        if token.isalpha() and not _LONG_RUN.search(token) and (found := self.stem(token)):
            return ((found, token),)
        hits = self.look(token)
        if hits:
            return tuple(hits)
        return _SHORT if len(_RUNS.sub(r"\1", "".join(c for c in token if c not in NOISE))) <= PIECE else None

    def look(self, token: str) -> list[tuple[str, str]]:
        """(stem, restored text) of what a token holds."""
        if (token.isalpha() and not _DOUBLE.search(token)) or not self.possible(token):
            return []
        begins = [m.start() == 0 or not token[m.start() - 1].isalpha() for m in _RUNS.finditer(token)]
        return self.scan(lattice(token), begins)

    def joined(self, text: str) -> tuple[tuple[str, str], ...]:
        """(stem, restored text) of words that are spread over pieces, which spaces are between."""
        if not self.possible(text.replace(" ", "")):
            return ()
        steps: Lattice = []
        begins: list[bool] = []
        gaps: list[int] = []
        single = False
        for k, piece in enumerate(text.split(" ")):
            own = lattice(piece)
            alone = len(_RUNS.sub(r"\1", piece.strip(NOISE))) <= 1
            if k:
                steps.append([("", _DROP if single and alone else _JOIN), (" ", 0.0)])
                begins.append(False)
                gaps.append(k - 1)
            single = alone
            steps += own
            begins += [True] + [False] * (len(own) - 1)
            gaps += [k] * len(own)
        return tuple(self.scan(steps, begins, gaps))

    def score(self, text: str | None) -> tuple[float, list[str]]:
        """(score, restored words that have a stem: those of single tokens in order, then those that are spread over several)."""
        if not text or not self.stems:
            return 0.0, []
        words = text.lower().split()
        found = list(map(self.cache.__getitem__, words))
        hits = [h for x in found if x for h in x]
        short = [i for i, x in enumerate(found) if x is _SHORT]
        start = 0
        for k in range(1, len(short) + 1):
            if k == len(short) or short[k] != short[k - 1] + 1:
                if k - start > 1:
                    hits += self.spaced[" ".join(words[short[start] : short[k - 1] + 1])]
                start = k
        return sum(self.stems[stem] for stem, _ in set(hits)), [w for _, w in hits]


_SHORT: tuple = ()


class _Cache(dict):
    """Results by text, of texts that aren't long; emptied when it is full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str):
        found = self.make(text)
        if len(text) <= 200:
            if len(self) > 400_000:
                self.clear()
            self[text] = found
        return found


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, int, int]:
    """((doc_id, text, toxic) of a bounded sample, toxic and other documents among all labels of known documents)."""
    marked = labels.select(F.col("doc_id").alias("__id"), "toxic").where("__id is not null and toxic is not null").groupBy("__id").agg(F.max("toxic").alias("toxic"))
    marked = marked.join(docs.select(F.col("doc_id").alias("__id")), "__id", "left_semi")
    half = max_labelled // 2
    toxic = marked.where("toxic = 1").orderBy(F.xxhash64("__id"), "__id").limit(half)
    clean = marked.where("toxic <> 1").orderBy(F.xxhash64("__id"), "__id").limit(max_labelled - half)
    sample = F.broadcast(toxic.union(clean))
    rows = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("__id"))
    counts = marked.agg(F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0)), F.count("*")).first()
    return rows.select("doc_id", "text", (F.col("toxic") == 1).alias("toxic")), counts[0], counts[1] - counts[0]


def learn_stems(rows: DataFrame, max_stem: int = MAX_STEM, enough: int = ENOUGH) -> dict[str, float]:
    """Word prefixes with the log ratio of their rates in toxic and in other documents."""
    word = F.explode(F.array_distinct(F.expr("regexp_extract_all(lower(text), '[\\\\p{L}]+', 0)"))).alias("word")
    by_word = rows.select("toxic", word).groupBy("word").agg(F.sum(F.col("toxic").cast("int")).alias("t"), F.sum((~F.col("toxic")).cast("int")).alias("c"))
    prefix = F.explode(F.expr(f"transform(sequence({MIN_STEM}, {max_stem}), n -> if(length(word) >= n - 1, substring(concat(word, ' '), 1, n), null))")).alias("stem")
    by_word = by_word.persist(StorageLevel.DISK_ONLY)
    total_t, total_c = (x or 0 for x in by_word.agg(F.sum("t"), F.sum("c")).first())
    if not total_t:
        return {}
    found = by_word.select(prefix, "t", "c").where("stem is not null").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    prior = total_t / (total_t + total_c)
    n, t = F.col("t") + F.col("c"), F.col("t").cast("double")
    clean_part = F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / n / F.lit(max(1 - prior, 1e-9)))).otherwise(0.0)
    evidence = t * F.log(t / n / F.lit(prior)) + clean_part
    rate = (F.col("c") + F.lit(0.5)) / F.lit(total_c + 1.0)
    ratio = t / F.lit(float(total_t)) / rate
    found = found.where("t > 0").withColumn("evidence", evidence).withColumn("ratio", ratio)
    kept = found.where((F.col("evidence") >= MIN_EVIDENCE) & (F.col("ratio") >= MIN_RATIO)).collect()
    by_word.unpersist()
    if not kept:
        return {}
    # Copies of a toxic document make all their words look toxic, so stems are chosen by what they explain: the one with most
    # evidence first, and a document no longer counts once ``enough`` of its words are explained.
    names = F.broadcast(rows.sparkSession.createDataFrame([(r.stem,) for r in kept], "stem string"))
    pairs = rows.where("toxic").select("doc_id", word).select("doc_id", prefix).join(names, "stem").groupBy("stem", "doc_id").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("stem").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "n"))).alias("docs"))
    docs = {r.stem: r.docs for r in pairs.collect()}
    holders: dict[int, list[str]] = {}
    for stem, held in docs.items():
        for d in held:
            holders.setdefault(d, []).append(stem)
    missing = dict.fromkeys(holders, enough)
    clean = {r.stem: r.c for r in kept}
    ratios = {r.stem: r.ratio for r in kept}

    def gain(stem: str) -> float:
        t, c = sum(docs[stem].values()), clean[stem]
        return t * math.log(t / (t + c) / prior) + (c * math.log(c / (t + c) / max(1 - prior, 1e-9)) if c else 0.0) if t else 0.0

    # Gains only fall, so a stem whose gain is still the greatest bound of all is the best one.
    heap = [(-gain(x), -len(x), x) for x in docs]
    heapq.heapify(heap)
    stems: dict[str, float] = {}
    while heap:
        bound, _, stem = heapq.heappop(heap)
        now = gain(stem)
        if now < MIN_EVIDENCE or sum(docs[stem].values()) < MIN_RATIO * clean[stem] * total_t / max(total_c, 1):
            continue
        if now < -bound - 1e-9:
            heapq.heappush(heap, (-now, -len(stem), stem))
            continue
        if any(x.startswith(stem) or stem.startswith(x) for x in stems):
            continue
        stems[stem] = math.log(ratios[stem])
        for d, n in list(docs[stem].items()):
            missing[d] -= n
            if missing[d] <= 0:
                for other in holders[d]:
                    docs[other].pop(d, None)
    return stems


def threshold(scores: np.ndarray, toxic: np.ndarray, n_toxic: int, n_clean: int) -> float:
    """The score that errs least, with either kind weighing what it does among all labels: the middle between neighbours."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], toxic[order]
    if not y.any() or y.all():
        return MIN_THRESHOLD
    missed = np.concatenate(([0], np.cumsum(y))) * (n_toxic / y.sum())
    wrong = np.concatenate(((~y)[::-1].cumsum()[::-1], [0])) * (n_clean / (~y).sum())
    cuts = np.concatenate(([s[0]], (s[1:] + s[:-1]) / 2, [s[-1] + 1]))
    cost = np.where(np.concatenate(([True], s[1:] > s[:-1], [True])), missed + wrong, np.inf)
    return max(MIN_THRESHOLD, float(cuts[int(np.argmin(cost))]))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_stem: int = MAX_STEM, enough: int = ENOUGH) -> Scorer:
    rows, n_toxic, n_clean = labelled(docs, labels, max_labelled)
    stems = learn_stems(rows, max_stem, enough)
    counts = chars.count(docs, 3).toPandas()
    scorer = Scorer(stems, language_model(counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.int64), dict.fromkeys(stems, 200.0)))
    if stems:
        known = rows.select(F.col("toxic").cast("bigint").alias("doc_id"), "text")
        sample = score(known, scorer).select("doc_id", "score").toPandas()
        scorer.threshold = threshold(sample["score"].to_numpy(float), sample["doc_id"].to_numpy() == 1, n_toxic, n_clean)
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score, toxic, terms) of every row; terms are the restored words that count."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer.stems, scorer.logs, scorer.threshold))

    def run(batches):
        own = Scorer(*shared.value)
        for batch in batches:
            for a, b in vec.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                scores, terms = zip(*(own.score(t) for t in part.column(1).to_pylist()))
                yield pa.record_batch([part.column(0), pa.array(scores, pa.float64()), pa.array([s >= own.threshold for s in scores]), pa.array(terms, pa.list_(pa.string()))], names=["doc_id", "score", "toxic", "terms"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, toxic boolean, terms array<string>")
