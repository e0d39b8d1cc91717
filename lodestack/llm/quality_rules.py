"""Quality rules: statistics of whole texts, fixed base rules, and a decision list learned from labels.

The list is learned by sequential covering: a rule, a conjunction of thresholds, is grown on two thirds of the labelled
rows to the best gain, cut back on the others, and takes the rows that it covers away before the next one is grown. Where
a rule fails on the others, the next best first condition is tried; the list ends when no first condition that gains gives
a rule that passes. Spark counts the labelled rows by the thresholds that they reach, and rules are grown over those
counts; the list becomes one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import WORD, others, quoted, stored

#: Labelled rows that are learned from at most: those whose hashed id is smallest.
LABELLED = 20_000
LEAST_COVERED, LEAST_PRECISION = 5, 0.95
#: Thresholds that are tried: quantiles of the rows of either label.
QUANTILES = [k / 24 for k in range(1, 24)] + [0.005, 0.02, 0.98, 0.995]

# Symbols that prose seldom has, and the bounds of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Bits of a packed number that hold a word's place; the others are of the hash of its window.
PLACE = 24
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What each statistic divides by what.
STATISTICS = {
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_chars"),
    "digit_share": ("n_digits", "n_chars"),
    "calls_per_word": ("n_calls", "n_words"),
}


def _covered(places: Column) -> Column:
    """How many words the three-word windows that start at these ascending places cover."""
    step = lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"))
    return F.aggregate(places, F.struct(F.lit(-3).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")), step, lambda acc: acc["n"])


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``, a struct of all columns of ``docs``, with the base counts and those that the statistics need.

    Repeated windows are found in an array of longs, a window's hash above its place, once sorted. Neighbours with equal
    hashes are held against the words; where they differ, or the text has 2**24 words or more, windows are sorted as
    strings. The counts are exact.
    """
    body, w, s, g = F.col("body"), F.col("words"), F.col("packed"), F.col("slow")
    places = F.sequence(F.lit(0), F.size(w) - 3)
    none = F.array().cast("array<bigint>")
    mask = (1 << PLACE) - 1
    # The table's own columns stand in one struct, so that none can clash with a name used here.
    df = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    df = df.withColumn("words", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    packed = F.transform(places, lambda i: F.shiftleft(F.xxhash64(w[i], w[i + 1], w[i + 2]), PLACE).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("packed", F.when(F.size(w) >= 3, F.sort_array(packed)).otherwise(none))
    same = lambda k: F.shiftright(s[k], PLACE) == F.shiftright(s[k - 1], PLACE)
    df = df.withColumn("twins", F.when(F.size(s) >= 2, F.filter(F.sequence(F.lit(1), F.size(s) - 1), same)).otherwise(F.array().cast("array<int>")))
    at = lambda k: s[k].bitwiseAND(F.lit(mask)).cast("int")
    alike = lambda a, b: (w[a] == w[b]) & (w[a + 1] == w[b + 1]) & (w[a + 2] == w[b + 2])
    df = df.withColumn("sure", (F.size(w) <= mask) & F.forall(F.col("twins"), lambda k: alike(at(k), at(k - 1))))
    found = F.sort_array(F.array_distinct(F.flatten(F.transform(F.col("twins"), lambda k: F.array(at(k).cast("bigint"), at(k - 1).cast("bigint"))))))
    df = df.withColumn("slow", F.when(~F.col("sure"), F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("g"), i.cast("bigint").alias("i"))))))
    twin = lambda x, k: ((k > 0) & (g[F.greatest(k - 1, F.lit(0))]["g"] == x["g"])) | ((k < F.size(g) - 1) & (g[F.least(k + 1, F.size(g) - 1)]["g"] == x["g"]))
    slowly = F.sort_array(F.transform(F.filter(g, twin), lambda x: x["i"]))
    without = lambda chars: F.length(body) - F.length(F.translate(body, chars, ""))
    df = df.withColumn("lines", F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)))
    counts = {
        "n_words": F.size(w), "word_chars": F.length(F.translate(body, " \t\n\x0b\x0c\r", "")), "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "n_repeat_words": F.when(F.size("twins") == 0, 0).when(F.col("sure"), _covered(found)).otherwise(_covered(slowly)),
        "n_lines": F.size("lines"), "n_chars": F.length(body), "n_upper": F.regexp_count(body, F.lit("[A-Z]")), "n_digits": F.regexp_count(body, F.lit("[0-9]")), "n_calls": without("!?"),
    }
    # Through a generator of one row: filters on the counts stay above it instead of repeating the work below.
    return df.select("row", F.inline(F.array(F.struct(*(v.cast("long").alias(k) for k, v in counts.items())))))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def statistic(name: str) -> Column:
    """A statistic of the counts; 0 where it has nothing to divide by."""
    what, over = (F.col(c).cast("double") for c in STATISTICS[name])
    return F.coalesce(F.try_divide(what, over), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def holds(self) -> Column:
        x = statistic(self.statistic)
        return x >= self.threshold if self.at_least else x < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.holds()
    return out


def _bin(name: str, thresholds: list[float]) -> Column:
    """How many thresholds the statistic has reached."""
    return F.size(F.filter(F.lit(thresholds), lambda t: t <= statistic(name)))


@dataclass(frozen=True)
class Groups:
    """Labelled rows that reach the same thresholds: ``bins`` has how many of each statistic's, ``bad`` and ``good`` their numbers."""

    bins: np.ndarray
    bad: np.ndarray
    good: np.ndarray

    def where(self, at: np.ndarray) -> Groups:
        return Groups(self.bins[at], self.bad[at], self.good[at])

    def covered(self, rule: Rule, thresholds: dict[str, list[float]]) -> np.ndarray:
        names, out = list(thresholds), np.ones(len(self.bins), bool)
        for c in rule:
            out &= (self.bins[:, names.index(c.statistic)] > thresholds[c.statistic].index(c.threshold)) == c.at_least
        return out


def _gaining(groups: Groups, thresholds: dict[str, list[float]]) -> list[Condition]:
    """The conditions that gain, best first."""
    all_p, all_n = groups.bad.sum(), groups.good.sum()
    if not all_p or not all_n:
        return []
    found = []
    for i, (name, own) in enumerate(thresholds.items()):
        p, n = (np.bincount(groups.bins[:, i], w, len(own) + 1).cumsum()[:-1] for w in (groups.bad, groups.good))
        for at_least, p_in, n_in in ((False, p, n), (True, all_p - p, all_n - n)):
            gain = np.where(p_in > 0, p_in * (np.log2(np.maximum(p_in, 1) / np.maximum(p_in + n_in, 1)) - np.log2(all_p / (all_p + all_n))), 0.0)
            found += [(g, i, k, at_least, Condition(name, at_least, own[k])) for k, g in enumerate(gain.tolist()) if g > 0]
    return [x[-1] for x in sorted(found, key=lambda x: (-x[0], *x[1:4]))]


def _grow(groups: Groups, first: Condition, thresholds: dict[str, list[float]]) -> Rule:
    """The conjunction that gains most from ``first`` on, a condition at a time, as long as one gains."""
    rule = (first,)
    while True:
        best = next(iter(_gaining(groups.where(groups.covered(rule, thresholds)), thresholds)), None)
        if best is None or best in rule:
            return rule
        rule += (best,)


def _prune(groups: Groups, rule: Rule, thresholds: dict[str, list[float]]) -> tuple[Rule, int, int]:
    """The leading part of ``rule`` that is worth most on ``groups``, with the bad and good rows that it covers there."""
    parts = []
    for k in range(1, len(rule) + 1):
        at = groups.covered(rule[:k], thresholds)
        parts.append((rule[:k], groups.bad[at].sum(), groups.good[at].sum()))
    return max(parts, key=lambda x: ((x[1] - x[2]) / (x[1] + x[2]) if x[1] + x[2] else -1.0, x[1], -len(x[0])))


def _next_rule(growing: Groups, others: Groups, thresholds: dict[str, list[float]]) -> Rule | None:
    """The rule of the best first condition that passes on ``others``; what fails is set aside. None if all do."""
    for first in _gaining(growing, thresholds):
        rule, p, n = _prune(others, _grow(growing, first, thresholds), thresholds)
        if p >= LEAST_COVERED and p >= LEAST_PRECISION * (p + n):
            return rule
    return None


def learn(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Ordered rules for bad documents, learned from those of at most ``LABELLED`` labelled documents that pass the base rules.

    ``labels`` has doc_id and quality (0 bad, 1 good; others and nulls are left out; of repeated rows the lower counts).
    Without rows of both kinds there are no rules. A rule stays if it covers ``LEAST_COVERED`` bad rows and is right on
    ``LEAST_PRECISION`` of what it covers among the rows that it wasn't grown on. Rules are learned until no first condition
    that gains on the rows that are left gives one that stays; each takes bad rows away, so the sample bounds their number.
    The driver holds a row for each set of thresholds that the labelled rows reach.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    told = with_statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    growing = F.pmod(F.xxhash64("row.doc_id", F.lit("split")), F.lit(3)) > 0
    rows = stored(told.where(~base_failed()).select((1 - F.col("row.quality")).cast("long").alias("bad"), growing.alias("growing"), *(c for c in told.columns if c != "row")), "labelled-statistics")
    names = list(STATISTICS)
    quantiles = rows.groupBy("bad").agg(*(F.percentile(statistic(k), F.array(*map(F.lit, QUANTILES))).alias(k) for k in names)).collect()
    if len(quantiles) < 2:
        return []
    thresholds = {k: sorted({x for r in quantiles for x in r[k]}) for k in names}
    reached = F.array(*(_bin(k, thresholds[k]) for k in names))
    told = rows.groupBy("growing", reached.alias("bins")).agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    growing, others = (
        Groups(np.array([r["bins"] for r in own], np.int64).reshape(-1, len(names)), np.array([r["p"] for r in own], np.int64), np.array([r["n"] for r in own], np.int64))
        for own in ([r for r in told if r["growing"] == of] for of in (True, False))
    )
    rules: list[Rule] = []
    while (rule := _next_rule(growing, others, thresholds)) is not None:
        rules.append(rule)
        growing, others = (g.where(~g.covered(rule, thresholds)) for g in (growing, others))
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The place, from 1, of the first rule that holds; null if none does."""
    out = F.when(F.lit(False), 0)
    for k, rule in enumerate(rules, 1):
        out = out.when(holds(rule), k)
    return out


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the base counts, ``base_failed``, ``rule`` (that rejects it, or null) and ``kept``.

    Null texts have no words. Own columns with these names, in any case, are replaced, others may have any name. Rows stay
    where they are, repeated ones too.
    """
    own = [*BASE, "base_failed", "rule", "kept"]
    told = with_statistics(docs, text).select("row", *BASE, base_failed().alias("base_failed"), rule_number(rules).alias("rule"))
    return told.select(*(F.col("row")[c].alias(c) for c in others(docs, own)), *own[:-1], (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
