"""Learned decision lists over text statistics.

Sequential covering: a rule is a conjunction of thresholds, grown condition by condition
for FOIL's information gain on two thirds of the labelled rows and pruned from its end on the
other third; the low-quality rows that it covers are taken away and the next rule is
grown, until a rule is no longer precise.  The list becomes one ordered Spark CASE expression;
statistics and decisions stay in the JVM.

Defined cases: a null text counts as an empty one; an empty text has 0 for all statistics;
labels that are null or of unknown documents are ignored, and of several labels of a document the
lowest counts; without labelled rows of both kinds the list is empty and everything is kept;
repeated rows are judged alike; extra columns are ignored by ``judge`` and kept by ``keep``, whatever their names;
empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerf.llm import vec

FEATURES = ("n_chars", "n_words", "word_chars", "upper_share", "symbol_share", "digit_share", "distinct_share", "repeated_lines", "longest_word")
#: Labelled rows that a list is fitted on at most: those of least hash.
MAX_LABELLED = 20_000
#: A rule must be right on this share of the pruning rows that it covers, and cover so many rows. Limits of a fitted list: rules,
#: conditions of a rule, thresholds that are tried for a statistic.
MIN_PRECISION, MIN_COVERED, MAX_RULES, MAX_CONDITIONS, CUTS = 0.9, 5, 16, 4, 64


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.feature)
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def mask(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.above else v < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold!r}"


Rule = tuple[Condition, ...]


def with_statistics(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """(``df`` with a struct of FEATURES as doubles, the struct's name, which is none of ``df``'s)."""
    stats_name, t, w, l = vec.unused(df.columns, "__stats", "__t", "__w", "__l")
    df = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(w, F.array_remove(F.split(t, r"\s+"), "")).withColumn(l, F.array_remove(F.split(t, r"\s*\n\s*"), ""))
    chars, words, lines = F.length(t), F.size(w), F.size(l)

    def share(n: Column, of: Column) -> Column:
        return F.when(of > 0, n / of).otherwise(F.lit(0.0)).cast("double")

    stats = {
        "n_chars": chars.cast("double"),
        "n_words": words.cast("double"),
        "word_chars": share(chars - words + 1, words),
        "upper_share": share(F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")), chars),
        "symbol_share": share(F.length(F.regexp_replace(t, r"[^#$%&*|!<>{}=~^_\\@+]+", "")), chars),
        "digit_share": share(F.length(F.regexp_replace(t, r"[^0-9]+", "")), chars),
        "distinct_share": share(F.size(F.array_distinct(w)), words),
        "repeated_lines": share(lines - F.size(F.array_distinct(l)), lines),
        "longest_word": F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).cast("double"),
    }
    return df.withColumn(stats_name, F.struct(*(c.alias(k) for k, c in stats.items()))).drop(t, w, l), stats_name


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - math.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: np.ndarray, bad: np.ndarray, max_conditions: int, max_cuts: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < max_conditions:
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p0 or not n0:
            break
        best = None
        for k, feature in enumerate(FEATURES):
            v, b = x[inside, k], bad[inside]
            values = np.unique(v)
            if len(values) < 2:
                continue
            cuts = (values[1:] + values[:-1]) / 2
            if len(cuts) > max_cuts:
                cuts = np.unique(np.quantile(cuts, np.linspace(0, 1, max_cuts), method="nearest"))
            order = np.argsort(v, kind="stable")
            under = np.searchsorted(v[order], cuts, "left")
            cum = np.concatenate(([0], np.cumsum(b[order])))
            for above, p, n in ((False, cum[under], under - cum[under]), (True, p0 - cum[under], n0 - (under - cum[under]))):
                g = _gain(p, n, p0, n0)
                i = int(np.argmax(g))
                if g[i] > 1e-9 and p[i] >= MIN_COVERED and (best is None or g[i] > best[0] + 1e-9):
                    best = (g[i], Condition(feature, above, float(cuts[i])))
        if best is None:
            break
        rule.append(best[1])
        inside &= best[1].mask(x)
    return tuple(rule)


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.mask(x) for c in rule]) if rule else np.ones(len(x), bool)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        m = covers(r, x)
        p, n = int(bad[m].sum()), int((~bad[m]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def _tightest(rule: Rule) -> Rule:
    """One condition for each feature and direction: the one that the others follow from."""
    kept: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        k = (c.feature, c.above)
        if k not in kept or (c.threshold > kept[k].threshold) == c.above:
            kept[k] = c
    return tuple(kept.values())


def fit(x: np.ndarray, quality: np.ndarray, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, cuts: int = CUTS) -> list[Rule]:
    """The decision list for rows of FEATURES and their quality, 0 or 1; every third row, in the order given, is for pruning."""
    bad = np.asarray(quality) == 0
    held = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules and bad[left & ~held].sum() >= MIN_COVERED and (~bad[left & ~held]).any():
        rule = _grow(x[left & ~held], bad[left & ~held], max_conditions, cuts)
        rule = _prune(rule, x[left & held], bad[left & held])
        m = covers(rule, x) & left
        p, n = bad[m & held].sum(), m[held].sum()
        p_all = bad[m].sum()
        if not rule or p_all < MIN_COVERED or (n and p / n < MIN_PRECISION) or p_all / m.sum() < MIN_PRECISION:
            break
        rules.append(_tightest(rule))
        left &= ~m
    return rules


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and quality of a bounded sample of labels of known documents, in hash order."""
    sample = labels.select(F.col("doc_id").alias("__id"), "quality").where("__id is not null and quality is not null").groupBy("__id").agg(F.min("quality").alias("quality"))
    sample = sample.join(docs.select(F.col("doc_id").alias("__id")), "__id", "left_semi")
    sample = sample.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    rows, stats = with_statistics(rows)
    rows = rows.select("doc_id", "quality", f"{stats}.*").distinct().toPandas()
    rows = rows.iloc[np.lexsort([rows[f] for f in FEATURES] + [rows.doc_id, [_spread(i) for i in rows.doc_id]])]
    return rows[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), rows["quality"].to_numpy()


def _spread(i: int) -> int:
    return (int(i) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % 2**64 >> 11


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **limits: int) -> list[Rule]:
    return fit(*labelled(docs, labels, max_labelled), **limits)


def expression(rules: list[Rule], prefix: str = "") -> Column:
    """The number of the first rule that holds, from 1, or null: one CASE WHEN."""
    out = F.lit(None).cast("int")
    if not rules:
        return out
    case = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column(prefix)
        for c in rule[1:]:
            holds = holds & c.column(prefix)
        case = F.when(holds, F.lit(k)) if case is None else case.when(holds, F.lit(k))
    return case.otherwise(out)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rule, keep) of every row; rule is null where none rejects it."""
    marked, stats = with_statistics(docs.select("doc_id", "text"))
    marked = marked.select("doc_id", expression(rules, f"{stats}.").alias("rule"))
    return marked.select("doc_id", "rule", F.col("rule").isNull().alias("keep"))


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that no rule rejects, with their columns."""
    marked, stats = with_statistics(docs)
    return marked.where(expression(rules, f"{stats}.").isNull()).drop(stats)
