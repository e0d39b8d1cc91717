"""The registered queries on the smallest tables, their SQL, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lodestack.llm import bpe, ngram_join, quality_rules, queries

DIR = "/root/testdata/sf0.001"
ROWS = {"op12_ranked_search": None, "op1_url_filters": "pages", "op5_embedding_dedup": "embeddings", "op7_warc": "pages"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    source = ROWS.get(name, "documents")
    assert len(rows) == (spark.read.parquet(f"{DIR}/{source}.parquet").count() if source else 400)
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
            c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
        told = c.sql(queries.ORACLE_SQL[name])
        assert sorted(told.columns) == sorted(df.columns)
        assert sorted(map(repr, rows)) == sorted(map(repr, told.project(", ".join(sorted(told.columns))).fetchall()))


def test_digests(spark):
    """The digest columns of op4 and op8 are those of plain patterns and of the library."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.rank_file(queries.RANKS).ranks, special_tokens={})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op8_byte_bpe(spark, DIR).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[r.doc_id]))
    kinds = [("assign", re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8), ("access", re.compile("(AKIA[A-Z0-9]+)"), 16), ("hex", re.compile("([0-9a-f]+)"), 32)]
    for r in queries.op4_secret_scans(spark, DIR).collect():
        found = sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, pattern, least) in enumerate(kinds) for m in pattern.finditer(texts[r.doc_id]) if len(m[1]) >= least)
        assert r.base_sha256 == sha(",".join(x[2] for x in found)) and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in found) for k in range(3))


def test_places_in_the_mix(spark):
    """A document's place is that of its first copy among all copies by position."""
    rows = queries.op9_mixing(spark, DIR).collect()
    placed = sorted((r.first_place, r.first_position) for r in rows if r.first_place is not None)
    assert [p for _, p in placed] == sorted(p for _, p in placed) and len({p for p, _ in placed}) == len(placed) and placed[0][0] == 1
    assert all((r.first_place is None) == (r.first_position is None) for r in rows)
    assert placed[-1][0] <= sum(r.taken // r["size"] if r["size"] else 1 for r in rows)


def test_near_copies_with_repeated_ids(spark):
    """A row goes for its text: texts under one id, or without id, don't take each other along, and equal rows leave one."""
    rnd = random.Random(3)
    prose = lambda: " ".join(f"w{rnd.randrange(500)}" for _ in range(80))
    a, b, c = prose(), prose(), prose()
    rows = [(1, a), (5, a), (5, b), (7, b + " z"), (8, c), (8, c), (8, c), (None, a), (None, a), (9, ""), (9, ""), (10, None), (5, c + " z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "mine") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `row.a` string")
    kept = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, DIR)
    assert kept.columns == docs.columns
    told = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(told, key=repr) == sorted([(1, a), (5, b), (5, c + " z"), (None, a), (None, a), (9, ""), (9, ""), (10, None)], key=repr)
    assert dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs.limit(0), DIR).collect() == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = dict(corpus_pipeline.STAGES)
    kept = stages[names[0]](spark, docs, DIR).cache()
    rules = quality_rules.learn(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert {r[0] for r in kept.select("doc_id").collect()} == {r.doc_id for r in quality_rules.judge(docs, rules).where("kept").collect()}
    single = stages[names[1]](spark, kept, DIR).cache()
    groups = ngram_join.join(kept.select("doc_id", "text"))
    assert {r[0] for r in single.select("doc_id").collect()} == {r[0] for r in groups.select("component_id").collect()}
    masked = stages[names[2]](spark, single, DIR).cache()
    assert masked.count() == single.count()
    live = queries.scanned(single, keep_text=False).where(F.exists("spans", lambda x: x["live"])).select("doc_id")
    assert {r[0] for r in live.collect()} == {r[0] for r in masked.where("contains(text, '[SECRET]')").select("doc_id").collect()}
    mixed = stages[names[3]](spark, masked, DIR).cache()
    assert mixed.columns == docs.columns and {r[0] for r in mixed.groupBy("doc_id").count().select("count").distinct().collect()} <= {1, 2, 3}
    last = stages[names[4]](spark, mixed, DIR)
    assert last.count() == mixed.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == sorted(map(tuple, last.collect()))


def test_pipeline_by_hand(spark, tmp_path):
    """On a small corpus of known parts the stages keep, drop, mask and copy what they must."""
    rnd = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("n", "rt", "sp", "m")]
    prose = lambda n=90: " ".join(rnd.choice(words) for _ in range(n))
    bodies = [prose() for _ in range(40)]
    texts = {i: t for i, t in enumerate(bodies)}
    texts |= {100: "too short", 101: "again and again " * 40, 102: None}  # the base rules reject these
    texts |= {200 + i: bodies[i] for i in range(5)} | {300 + i: bodies[i] + f" {words[i]}" for i in range(5)}  # copies and near copies
    key = "aB3" + "".join(rnd.choice("abcDEF456") for _ in range(30))
    texts |= {400: prose() + f" {key} end", 401: prose() + " password=hunter2hunter2"}
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet").select(*corpus_pipeline.COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = docs.collect()
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    rules, join, secrets, mix, encode = (n for n, _ in corpus_pipeline.STAGES)
    assert ids(rules) == sorted(i for i in texts if i not in (100, 101, 102))
    assert ids(join) == ids(secrets) == [*range(40), 400, 401]
    masked = {r.doc_id: r.text for r in seen[secrets]}
    assert masked[400] == texts[400].replace(key, "[SECRET]") and masked[401] == texts[401].replace("password=hunter2hunter2", "[SECRET]")
    assert all(masked[i] == bodies[i] for i in range(40)) and all(r.n_chars == len(r.text) for r in seen[secrets])
    # Two sources weigh 5 and 2: so many of their words, up to three times each, make up the sum of all.
    size = lambda source, name: sum(len(r.text.split(" ")) for r in seen[name] if r.source == source)
    total = size("s0", secrets) + size("s1", secrets)
    assert abs(size("s0", mix) - 5 / 7 * total) <= 95 and abs(size("s1", mix) - 2 / 7 * total) <= 95
    assert {r.text for r in seen[mix]} <= set(masked.values())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.rank_file(queries.RANKS).ranks, special_tokens={})
    want = sorted((r.doc_id, len(library.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in seen[mix])
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in seen[encode]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen[encode]))
