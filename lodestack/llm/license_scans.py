"""Licence scans by template markup: templates compiled to automata over words, which accept texts whose mandatory wording stands exactly.

A template's optional, alternative and replaceable regions become branches of an automaton whose arcs are words, or any
word. Its sets of states are made into states of their own as texts reach them, so a step is one look-up. A text is
tried only from words that a template can begin with, and only if it holds the template's longest mandatory phrase; a
try ends after the template's longest wording at the latest, so the work on a text grows with its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import others, quoted
from lodestack.llm.license_templates import TEMPLATES
from lodestack.llm.plain_words import TABLE, words_of

# The base phrases and their labels.
PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
#: Stands for any word on an arc.
ANY = None
Arc = tuple[bytes | None, int]


class Template:
    """An automaton for one template: ``start`` and ``end`` are states, ``arcs`` lead on by a word, ``free`` without one."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.arcs: list[list[Arc]] = []
        self.free: list[list[int]] = []
        tokens = re.findall(r"[\[\]<>|]|:\d+(?=>)|[^\[\]<>|:]+|:", markup)
        self.start = self._state()
        self.end, rest = self._sequence(self.start, tokens)
        if rest:
            raise ValueError(f"{label}: {rest[0]} without its beginning")
        self.phrase = self._longest_phrase(markup)
        self._sets: dict[frozenset[int], int] = {}
        self._members: list[frozenset[int]] = []
        self._steps: list[dict[bytes | None, int]] = []
        self.accepting: list[bool] = []
        self._first = self._numbered(self._closed({self.start}))
        self.begins = {w for s in self._members[self._first] for w, _ in self.arcs[s]}
        if ANY in self.begins or self.accepting[self._first]:
            raise ValueError(f"{label}: a template must begin with wording")

    def _state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def _sequence(self, at: int, tokens: list[str]) -> tuple[int, list[str]]:
        """Builds regions one after the other from state ``at``; gives the last state and what isn't used, from a closing mark on."""
        while tokens and tokens[0] not in ("]", ">", "|") and not re.fullmatch(r":\d+", tokens[0]):
            if tokens[0] == "[":
                before, (at, tokens) = at, self._sequence(at, tokens[1:])
                tokens = self._closing("]", tokens)
                self.free[before].append(at)
            elif tokens[0] == "<":
                at, tokens = self._choice(at, tokens[1:])
            else:
                for word in words_of(tokens[0].encode()):
                    after = self._state()
                    self.arcs[at].append((word, after))
                    at = after
                tokens = tokens[1:]
        return at, tokens

    def _closing(self, mark: str, tokens: list[str]) -> list[str]:
        if not tokens or tokens[0] != mark:
            raise ValueError(f"{self.label}: no {mark}")
        return tokens[1:]

    def _choice(self, before: int, tokens: list[str]) -> tuple[int, list[str]]:
        if len(tokens) > 1 and re.fullmatch(r":\d+", tokens[1]):  # <name:n>: the name is for readers
            at, end = before, self._state()
            self.free[at].append(end)
            for _ in range(int(tokens[1][1:])):
                after = self._state()
                self.arcs[at].append((ANY, after))
                self.free[after].append(end)
                at = after
            return end, self._closing(">", tokens[2:])
        end = self._state()
        while True:
            begin = self._state()
            self.free[before].append(begin)
            at, tokens = self._sequence(begin, tokens)
            self.free[at].append(end)
            if not tokens or tokens[0] != "|":
                return end, self._closing(">", tokens)
            tokens = tokens[1:]

    @staticmethod
    def _longest_phrase(markup: str) -> bytes:
        """The longest wording in a row outside all regions."""
        depth, parts = 0, [""]
        for c in markup:
            depth += (c in "[<") - (c in "]>")
            if depth or c in "]>":
                parts.append("")
            else:
                parts[-1] += c
        return max((b" ".join(words_of(p.encode())) for p in parts), key=len)

    def _closed(self, states: set[int]) -> frozenset[int]:
        left, found = list(states), set(states)
        while left:
            for s in self.free[left.pop()]:
                if s not in found:
                    found.add(s)
                    left.append(s)
        return frozenset(found)

    def _numbered(self, states: frozenset[int]) -> int:
        """The number of a set of states; 0 is not given to any: it stands for none."""
        if states not in self._sets:
            if not self._members:
                self._members.append(frozenset())
                self._steps.append({})
                self.accepting.append(False)
            self._sets[states] = len(self._members)
            self._members.append(states)
            self._steps.append({})
            self.accepting.append(self.end in states)
        return self._sets[states]

    def _step(self, at: int, word: bytes) -> int:
        """The set after ``word``. A word that no arc names leads where any word does, under one entry."""
        steps = self._steps[at]
        if not steps:
            named = {w for s in self._members[at] for w, _ in self.arcs[s]} | {ANY}
            for w in named:
                onto = {to for s in self._members[at] for x, to in self.arcs[s] if x is ANY or x == w}
                steps[w] = self._numbered(self._closed(onto)) if onto else 0
        return steps.get(word, steps[ANY])

    def longest(self, words: list[bytes], start: int) -> int:
        """The end of the longest wording that begins at ``start``; ``start`` itself if there is none."""
        at, end = self._first, start
        for i in range(start, len(words)):
            at = self._step(at, words[i])
            if not at:
                break
            if self.accepting[at]:
                end = i + 1
        return end

    def places(self, words: list[bytes], starts: list[int]) -> Iterator[tuple[int, int]]:
        """The leftmost longest places of the template that don't overlap; ``starts`` are those of words that begin it."""
        upto = 0
        for s in starts:
            if s >= upto:
                end = self.longest(words, s)
                if end > s:
                    yield s, end
                    upto = end


class Scanner:
    """All templates: they share the pass over a text's words."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = [Template(label, markup) for label, markup in templates]
        self.begins = {w for t in self.templates for w in t.begins}

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """How many words a text has, the base places and those of templates (start, end, label), by start."""
        plain = b" " + b" ".join(raw.translate(TABLE).split()) + b" "
        if len(plain) == 2:
            return 0, [], []
        n = plain.count(b" ") - 1
        base = _phrase_places(plain)
        near = [t for t in self.templates if b" " + t.phrase + b" " in plain]
        if not near:
            return n, base, []
        words = plain[1:-1].split(b" ")
        at = [(i, w) for i, w in enumerate(words) if w in self.begins]
        found = [(a, b, t.label) for t in near for a, b in t.places(words, [i for i, w in at if w in t.begins])]
        return n, base, sorted(found)


def _phrase_places(plain: bytes) -> list[tuple[int, int, str]]:
    """Places of the base phrases in words that one space parts; words before a place are counted once."""
    found = []
    for phrase, label in PHRASES.items():
        at, here, words = plain.find(b" " + phrase + b" "), 0, 0
        while at >= 0:
            words += plain.count(b" ", here, at)
            here = at
            found.append((words, words + phrase.count(b" ") + 1, label))
            at = plain.find(b" " + phrase + b" ", at + 1)
    return sorted(found)


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(list(templates))


SPANS = "array<struct<label:string,start:bigint,end:bigint>>"


def scanned(text: Column, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)) -> Column:
    """Struct of n_words, base and found, spans of words with exclusive ends, and covered, the words that any of them covers."""
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ["n_words", "base", "found", "covered"]

    @F.arrow_udf(f"n_words bigint, base {SPANS}, found {SPANS}, covered bigint")
    def told(texts: pa.Array) -> pa.Array:
        known, out = scanner(templates), [[] for _ in names]
        for raw in texts:
            n, base, found = known.scan(raw.as_py() or b"")
            listed = [[{"label": x, "start": a, "end": b} for a, b, x in spans] for spans in (base, found)]
            for column, value in zip(out, (n, *listed, _covered(sorted(base + found))), strict=True):
                column.append(value)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), span, span, pa.int64()), strict=True)], names)

    return told(text.cast("binary"))


def _covered(spans: list[tuple[int, int, str]]) -> int:
    total = upto = 0
    for a, b, _ in spans:
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


OWN = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with what is told of licences in them.

    ``n_words``; ``n_base``, how many places base phrases have, ``first_word`` and ``last_word``, the smallest and largest word
    at which one starts (from 0; null without any), ``base_labels``; ``labels``, also those of accepted templates (both sorted,
    comma-joined, empty without any); ``spans`` of both kinds by start (label, start, end in words); ``score``, the share of the text's
    words that spans cover, 0 for a text without words. A template is accepted where all its mandatory wording stands, word for
    word; of a template's places the leftmost and there the longest counts, and its places don't overlap.

    ``templates`` are (label, markup) as in ``license_templates``. Null texts count as empty. Own columns with these names, in
    any case, are replaced; others may have any name. Rows stay where they are, repeated ones too.
    """
    told = scanned(F.col(quoted([text])[0]), tuple(templates) if templates is not None else tuple(TEMPLATES))
    # The table's own columns stand in one struct, so that none can clash with a name used here.
    kept = others(docs, OWN)
    rows = docs.select(F.struct(*quoted(kept), F.lit(0).alias("")).alias("row"), told.alias("t"))
    starts, labels = F.col("t.base.start"), lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    out = [
        F.col("t.n_words"), F.size("t.base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("t.base.label")).alias("base_labels"), labels(F.concat("t.base.label", "t.found.label")).alias("labels"),
        F.when(F.col("t.n_words") > 0, F.col("t.covered") / F.col("t.n_words")).otherwise(0.0).alias("score"),
        F.transform(F.array_sort(F.transform(F.concat("t.base", "t.found"), lambda x: F.struct(x["start"], x["end"], x["label"]))), lambda x: F.struct(x["label"], x["start"], x["end"])).alias("spans"),
    ]
    return rows.select("row", *out).select(*(F.col("row")[c].alias(c) for c in kept), *OWN)
