"""Licence scans, ranked search and importance resampling against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import importance_sample, license_scans, queries, ranked_search
from lodestack.llm.license_templates import TEMPLATES

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(low(text or ""))


# ---- 11 ----


def pattern(markup: str) -> str:
    """A template as a pattern over words that a space follows each."""
    out = ""
    for part in re.findall(r"<[\w-]+:\d+>|[\[\]<>|]|[^\[\]<>|]+", markup):
        if named := re.fullmatch(r"<[\w-]+:(\d+)>", part):
            out += rf"(?:\S+ ){{0,{named[1]}}}"
        else:
            out += {"[": "(?:", "]": ")?", "<": "(?:", ">": ")", "|": "|"}.get(part) or "".join(re.escape(w) + " " for w in words(part))
    return out


def accepted(markup: str, text: str) -> list[tuple[int, int]]:
    """Leftmost longest places that don't overlap, every end tried."""
    own, whole, at, out = words(text), re.compile(pattern(markup)), 0, []
    joined, offsets = "".join(w + " " for w in own), [0]
    for w in own:
        offsets.append(offsets[-1] + len(w) + 1)
    while at < len(own):
        ends = [j for j in range(at + 1, min(len(own), at + 150) + 1) if whole.fullmatch(joined, offsets[at], offsets[j])] if whole.match(joined, offsets[at]) else []
        if ends:
            out.append((at, ends[-1]))
        at = ends[-1] if ends else at + 1
    return out


CASES = [
    "Licensed under CC BY-NC 4.0.", "it is Released under the terms of the MIT (Expat) License!", "licensed under the apache license", "Licensed under the Apache License, Version 2.0, or licensed under the Apache License 2.0",
    "distributed under the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. mit license",
    "released under the GNU general public license, version 4", "published under a Creative Commons Attribution Non Commercial Share Alike 3.0 International license", "licensed under CC BY ND", "available under the licensed under the mit license",
    TEMPLATES[1][1].replace("[", "").replace("]", ""), TEMPLATES[1][1].replace("[(including the next paragraph)]", ""), TEMPLATES[1][1].replace("sublicense", "sell"),
    TEMPLATES[3][1].replace("<thing:2>", "file").replace("<place:12>", "http://www.apache.org/licenses/LICENSE-2.0"), TEMPLATES[3][1].replace("<thing:2>", "").replace("<place:12>", "a " * 13),
    TEMPLATES[7][1].replace("[1.]", "* ").replace("[2.]", "").replace("<holder:12>", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    TEMPLATES[8][1].replace("[1.]", "1.").replace("[2.]", "2.").replace("[3.]", "3.").replace("<holder:12>", "the University of X, Ltd").replace("<whose:2>", "its"),
    TEMPLATES[9][1].replace("[/or]", "/or"), TEMPLATES[10][1].replace("[,]", ""), "THIS is free & unencumbered software", TEMPLATES[11][1],
]


@pytest.mark.parametrize("case", CASES)
def test_templates(case):
    """The automata accept what patterns of the same templates accept."""
    n, base, found = license_scans.scanner(tuple(TEMPLATES)).scan(case.encode())
    assert n == len(words(case))
    assert found == sorted((a, b, label) for label, markup in TEMPLATES for a, b in accepted(markup, case))


def test_markup():
    """Nested and empty regions, alternatives and replaceable words, at random against patterns."""
    rnd = random.Random(4)

    def region(depth: int) -> str:
        kind = rnd.choice("www[<:" if depth else "www:")
        if kind == "w":
            return " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 2)))
        if kind == "[":
            return f"[{region(depth - 1)} {region(depth - 1)}]"
        return f"<x:{rnd.randint(0, 2)}>" if kind == ":" else f"<{region(depth - 1)}|{region(depth - 1)}>"

    some = 0
    for _ in range(300):
        markup = f"a {region(2)} {region(2)} {region(2)} b"
        template = license_scans.Template("t", markup)
        for _ in range(10):
            text = " ".join(rnd.choice("abcx") for _ in range(rnd.randint(0, 14)))
            own = words(text)
            got = list(template.places([w.encode() for w in own], [i for i, w in enumerate(own) if w.encode() in template.begins]))
            assert got == accepted(markup, text), (markup, text)
            some += bool(got)
    assert some > 300
    for wrong in ("[a", "a]", "<a|b", "a > b", "<x:3> a", "[a]", ""):
        with pytest.raises(ValueError):
            license_scans.Template("t", wrong)


def test_licenses_of_documents(spark):
    odd = [(1, None), (2, ""), (3, "..."), (4, "MIT License mit-license"), (4, "MIT License mit-license"), (None, "the GNU General Public License"), (5, "mıt license"), (6, "a " * 50_000 + "apache/license"), *((100 + i, c) for i, c in enumerate(CASES))]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("Labels", F.lit("gone"))
    rows = license_scans.scan(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        own = words(r.text)
        base = sorted((i, i + len(p.split()), label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(own)) if own[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(base), base[0][0] if base else None, base[-1][0] if base else None)
        assert r.base_labels == ",".join(sorted({x[2] for x in base})) and [(s.start, s.end, s.label) for s in r.spans] == sorted([(s.start, s.end, s.label) for s in r.spans])
        assert {x[2] for x in base} <= set(r.labels.split(",")) and r.labels == ",".join(sorted({s.label for s in r.spans})) and 0 <= r.score <= 1
        covered = {i for s in r.spans for i in range(s.start, s.end)}
        assert r.score == pytest.approx(len(covered) / len(own) if own else 0.0)
        if len(own) < 400:
            found = sorted((a, b, label) for label, markup in TEMPLATES for a, b in accepted(markup, r.text or ""))
            assert sorted(base + found) == [(s.start, s.end, s.label) for s in r.spans]
    assert license_scans.scan(docs.limit(0)).collect() == []
    own = license_scans.scan(docs.where("text = 'MIT License mit-license'"), templates=[("twice", "license <x:1> license")]).first()
    assert own.labels == "mit,twice" and own.score == 1.0


# ---- 12 ----


def best(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    counts = [(i, Counter(words(t))) for i, t in docs]
    df = Counter(w for _, c in counts for w in c)
    n, length = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in counts:
            m = 100 - 90 + (90 * c.total() * n) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words(text)) if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("hot", "sent"), [(4_000, 200_000), (3, 200_000), (3, 0)])
def test_search(spark, monkeypatch, hot, sent):
    """Whole scores, ties by id; hot terms dealt by document; tables too large to be sent round."""
    monkeypatch.setattr(ranked_search, "HOT", hot)
    monkeypatch.setattr(ranked_search, "TERMS_SENT", sent)
    monkeypatch.setattr(ranked_search, "AT_ONCE", 50)
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("alpha Beta gamma-delta É é 好 x1 the the the the of".split()) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 30))) for i in range(60)] + [(90 + i, "same same text") for i in range(15)] + [(3, "same text"), (None, "beta"), (200, None), (201, "?!"), (202, "rare")]
    items = [(1, "same text, the"), (2, "É of rare"), (2, "É of rare"), (2, "gamma"), (3, None), (4, "..."), (None, "Delta beta"), (5, "absent"), (6, text(40))]
    told = ranked_search.search(spark.createDataFrame([(i, t, 1, 1) for i, t in docs], "doc_id long, text string, row int, `a.b` int"), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string"))
    assert told.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, told.collect()), key=repr) == best(docs, items, 10)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs.select("doc_id", F.lit(None).cast("string").alias("text")), items)):
        assert ranked_search.search(d, i).collect() == []


# ---- 13 ----


def features(text: str | None) -> list[int]:
    own = words(text)
    return [crc32(" ".join(own[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(own) - n + 1)]


def drawn(docs: list[tuple], target: list[str | None]) -> list[tuple]:
    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for i, x in docs:
        own = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    order = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(order[: 5 * len(order) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("in_a_range", "samples", "at_once", "block"), [(200_000, 64, 500_000, 2_048), (7, 3, 40, 3), (3, 64, 9, 1)])
def test_draw(spark, monkeypatch, in_a_range, samples, at_once, block):
    """One range or many, runs and blocks of few rows; equal rows, equal ids with other texts, rows without id, short texts."""
    for name, value in (("IN_A_RANGE", in_a_range), ("SAMPLES", samples), ("AT_ONCE", at_once), ("IN_A_BLOCK", block)):
        monkeypatch.setattr(importance_sample, name, value)
    rnd = random.Random(6)
    text = lambda n: " ".join(rnd.choice("alpha Beta gamma-delta É é 好 x1 the".split()) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 45))) for i in range(900)]
    docs += [(2000, "target words " * 20)] * 30 + [(2001, "target words " * 20 + "x"), (2001, "target words " * 20), (None, "target words " * 15), (None, None), (1, None), (2, "")]
    target = ["target words " * 9, None, "", "beta x1 the the"]
    frame = spark.createDataFrame([(i, t, 1, 1) for i, t in docs], "doc_id long, text string, row int, `a.b` int").repartition(5)
    told = importance_sample.resample(frame, spark.createDataFrame([(t, 1) for t in target], "text string, down int"))
    assert told.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted(map(tuple, told.collect()), key=repr)
    assert got == drawn(docs, target) and sum(r[4] is not None for r in got) > 20


def test_draw_of_nothing(spark):
    docs, target = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string"), spark.createDataFrame([("a c",)], "text string")
    assert importance_sample.resample(docs.limit(0), target).collect() == []
    for t in (target, target.limit(0)):
        rows = [(1, "a b " * 20), (2, None)]
        assert sorted(map(tuple, importance_sample.resample(docs, t).collect()), key=repr) == drawn(rows, [r[0] for r in t.collect()])


def test_long_texts_in_stretches(monkeypatch):
    """A text's features and words don't hang on where its stretches end."""
    from lodestack.llm import plain_words

    text = "éa " + "b1 " * 7 + "?" * 9 + "Word " * 5 + "x" * 40
    for size in (1, 2, 5, 1000):
        assert [w for part in plain_words.stretches(text.encode(), size) for w in part] == [w.encode() for w in words(text)]
        monkeypatch.setattr(importance_sample, "stretches", lambda raw, size=size: plain_words.stretches(raw, size))
        assert sorted(np.concatenate([*importance_sample.features(text.encode()), np.zeros(0, np.int64)]).tolist()) == sorted(features(text))


def test_tournament():
    """Blocks of sorted runs that come by their first keys merge into order, and stop where they are told."""
    rnd = random.Random(7)
    for _ in range(80):
        runs = [sorted([rnd.randint(0, 30), 0, rnd.randint(0, 9), 0, 100 * k + i] for i in range(rnd.randint(1, 20))) for k in range(rnd.randint(1, 9))]
        size = rnd.randint(1, 5)
        blocks = sorted(((tuple(run[i]), np.array([[*x, 0] for x in run[i : i + size]])) for run in runs for i in range(0, len(run), size)), key=lambda b: b[0])
        every = sorted(x for run in runs for x in run)
        most = rnd.randint(0, len(every))
        merged, left = [], []
        for rows, a, b in importance_sample._merged(iter(blocks), most):
            (left if b < 0 else merged).extend(rows[a:].tolist() if b < 0 else rows[a:b].tolist())
        assert [x[:5] for x in merged] == every[:most] and sorted(x[:5] for x in left) == every[most:]


def test_queries_read_all(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op12_ranked_search(spark, DIR).collect()), key=repr) == best(docs, items, 10)
    assert sorted(map(tuple, queries.op13_importance_sample(spark, DIR).collect()), key=repr) == drawn(docs, [t for _, t in items])
