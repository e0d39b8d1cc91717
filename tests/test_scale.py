"""What must hold at any size: selection by rank, the index that follows its chunks, pruned searches, joins of anchors."""

from __future__ import annotations

import math
import random
import time
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import queries
from lodestack.functions import kernels, remote, split, tables
from lodestack.operators import anchors, monitor, pivots, retrieval
from lodestack.operators import index as indexes
from lodestack.sources import items, shared
from lodestack.sources import store as store_module
from lodestack.sources.store import DuplicateLabel, NoChunks, Store
from lodestack.streaming import query_log


@pytest.mark.parametrize("in_a_range", [1_000_000, 7, 1])
def test_nearest_ranks(spark, monkeypatch, in_a_range):
    """Each key's value at its rank, however few values a range has; hot keys and values, null keys, nulls that don't count."""
    monkeypatch.setattr(monitor, "IN_A_RANGE", in_a_range)
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([None, 5.0, 5.0, 5.0, rnd.random(), -rnd.random()])) for _ in range(400)] + [("one", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    by = defaultdict(list)
    for k, v in rows:
        if v is not None:
            by[k].append(v)
    for share in (0.95, 0.5, 0.0, 1.0):
        want = {k: sorted(v)[max(1, math.ceil(share * len(v))) - 1] for k, v in by.items()}
        got = monitor.nearest_ranks(df, "v", share, F.col("k")).collect()
        assert len(got) == len(want) and {r.key: r.value for r in got} == want
    log = df.select("k", F.col("v").alias("total_ms"), *(F.lit(1.0).alias(c) for c in ("embed_ms", "retrieve_ms", "top_score")), F.lit(False).alias("is_empty_recall"))
    told = {r.k: r.p95_total_ms for r in monitor.metrics_by(log, "k").collect()}
    assert told == {k: sorted(by[k])[math.ceil(0.95 * len(by[k])) - 1] if by[k] else 0.0 for k in {k for k, _ in rows}}
    assert monitor.metrics(log.limit(0)).first().p95_total_ms == 0.0 and monitor.metrics(log).count() == 1


def test_index_follows_chunks(spark, tmp_path):
    """Only texts without a vector are embedded: a vectoriser that never gives the same twice shows which."""
    vectorise = lambda text: F.array(F.length(text).cast("double"), F.rand())
    store = Store(spark, str(tmp_path / "store"))
    kept = indexes.Index(store)
    told = lambda rows: spark.createDataFrame(rows, "chunk_id string, chunk_text string, page int")
    refreshed = lambda rows: dict(map(tuple, kept.refresh(told(rows), F.col("chunk_text"), vectorise).collect()))
    vectors = lambda: {r.chunk_id: tuple(r.vector) for r in kept.read().collect()}
    rows = [(str(i), f"text {i}", i) for i in range(40)] + [("twin", "text 1", 0)]
    assert refreshed(rows) == {"embedded": 41}
    first = vectors()
    assert len(first) == 41 and first["twin"] == first["1"] and all(abs(r.norm - math.hypot(*r.vector)) < 1e-9 for r in kept.read().collect())
    assert refreshed(rows) == {} and vectors() == first
    rows[3], rows[4], rows[5] = ("3", "other", 3), ("4", "text 4", 99), ("new", "text 5", 5)
    assert refreshed(rows) == {"embedded": 1, "carried": 2, "gone": 1}
    second = vectors()
    assert second.keys() == first.keys() - {"5"} | {"new"} and second["new"] == first["5"]
    assert {k for k in second if k in first and second[k] != first[k]} == {"3"}
    assert {r.chunk_id: r.page for r in kept.read().collect()}["4"] == 99
    assert store.read("index").count() == 41 and store.read("index_later").count() == 4  # the base wasn't written again
    rows = [r for r in rows if r[0] != "new"] + [("5", "text 5", 5)]  # its vector is that of the row which goes
    assert refreshed(rows) == {"carried": 1, "gone": 1} and vectors()["5"] == first["5"]
    rows = [(f"x{i}", t, p) for i, (_, t, p) in enumerate(rows)]
    assert refreshed(rows) == {"carried": 41, "gone": 41}
    assert store.read("index").count() == 41 and store.read("index_later").count() == 0  # the later rows became too many
    full = indexes.Index(store, "again")
    length = lambda text: F.array(F.length(text).cast("double"))
    full.refresh(told(rows), F.col("chunk_text"), length)
    assert sorted((r.chunk_id, r.chunk_text, r.page, r.vector[0]) for r in kept.read().collect()) == sorted((r.chunk_id, r.chunk_text, r.page, r.vector[0]) for r in full.read().collect())
    assert refreshed([]) == {"gone": 41} and vectors() == {}


def test_texts_of_an_index_are_stored_few_times(spark, tmp_path, monkeypatch):
    """The text to embed isn't stored beside the chunk's, a first table isn't stored aside; a delta can be had before it is taken up."""
    stored = []
    record = lambda df, name="table": (stored.append((name, df.columns)), shared.settled(df, name))[1]
    monkeypatch.setattr(indexes, "settled", record)
    monkeypatch.setattr(store_module, "settled", record)
    kept = indexes.Index(Store(spark, str(tmp_path / "store")))
    rows = spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)], "chunk_id long, chunk_text string")
    length = lambda text: F.array(F.length(text).cast("double"))
    assert dict(map(tuple, kept.refresh(rows, F.col("chunk_text"), length).collect())) == {"embedded": 20}
    assert "index" not in dict(stored) and not any("embedded" in columns for _, columns in stored)
    delta = kept.delta(rows.where("chunk_id > 1").withColumn("chunk_text", F.concat("chunk_text", F.when(F.col("chunk_id") == 7, "!").otherwise(""))), F.col("chunk_text"), length)
    assert kept.read().count() == 20 and dict(map(tuple, kept.follow(delta).collect())) == {"embedded": 1, "gone": 2}
    assert {r.chunk_id: r.vector for r in kept.read().collect()} == {i: [7.0 if i == 7 else 6.0] for i in range(2, 20)}


def test_pivots(spark):
    """The rows of a full scan, of which a share is looked at; odd vectors, ties, excluded rows."""
    rnd = random.Random(2)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rnd.gauss(0, 0.05) for x in rnd.choice(centres)]) for i in range(1500)]
    rows += [(2000 + i, list(rows[7][1])) for i in range(30)] + [(3000, None), (3001, [0.0] * 8), (3002, [])]
    index = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(str(i), v, i) for i, v in rows[:60]] + [("far", [1.0] * 8, None), ("zero", [0.0] * 8, None), ("null", None, None)], "query_id string, vector array<double>, exclude long")
    plain = lambda found: sorted((r.query_id, r.chunk_id, r["rank"], round(r.score, 9)) for r in found.collect())
    want = plain(retrieval.candidates(asked, index, 5))
    found, looked = pivots.nearest(asked, pivots.pivoted(index, 20), 5)
    assert plain(found) == want and len(want) == 61 * 5 and 0 < looked < 0.5
    assert plain(pivots.nearest(asked, pivots.pivoted(index), 5)[0]) == want
    assert pivots.nearest(asked.limit(0), pivots.pivoted(index), 5)[0].collect() == [] and pivots.nearest(asked, pivots.pivoted(index.limit(0)), 5)[0].collect() == []


def test_queries_have_ids_of_their_own(spark):
    index = spark.createDataFrame([(1, [1.0])], "chunk_id long, vector array<double>")
    with pytest.raises(ValueError, match="ids of their own"):
        retrieval.candidates(spark.createDataFrame([("a", [1.0]), ("a", [2.0])], "query_id string, vector array<double>"), index, 1)


def test_plain_filters(spark):
    """Filters on typed columns are comparisons, and fit what the general form fits."""
    rows = [(1, "x", True, 1.5, [1]), (2, "1", False, 1.0, None), (None, None, None, None, [2]), (1, "", None, float("nan"), [1])]
    df = spark.createDataFrame(rows, "chunk_id long, s string, b boolean, d double, a array<int>")
    for name in ("chunk_id", "s", "b", "d", "a", "absent"):
        for value in (None, 1, 1.0, 2, 1.5, True, False, "x", "1", "", [1], {"k": 1}, 10**20):
            told = [df.where(retrieval.matches({name: value}, columns)).collect() for columns in (df.columns, df.dtypes)]
            assert sorted(map(repr, told[0])) == sorted(map(repr, told[1])), (name, value)
    plan = df.where(retrieval.matches({"chunk_id": 1, "s": "x"}, df.dtypes))._jdf.queryExecution().optimizedPlan().toString()
    assert "variant" not in plan and "json" not in plan


@pytest.mark.parametrize("sent", [500_000, 0])
def test_anchors(spark, monkeypatch, sent):
    """Anchors of every length against plain containment; hot grams, repeats, odd bytes; nothing but lengths is collected."""
    monkeypatch.setattr(anchors, "GRAMS_SENT", sent)
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("aab é好\n") for _ in range(n))
    chunks = [(i, text(rnd.choice([0, 3, 20, 60, 200]))) for i in range(120)] + [(200, None), (201, "a" * 300), (202, "x")]
    found = ["", None, "x", "a" * 40, "a" * 301, "zz"] + [t[k : k + n] for _, t in rnd.sample(chunks[:120], 80) for n in (1, 2, 5, 7, 8, 9, 15, 30, 31, 60) if t for k in [rnd.randrange(len(t))]]
    df = spark.createDataFrame(chunks, "chunk_id long, chunk_text string")
    got = anchors.holding(df, spark.createDataFrame([(a, 1) for a in found], "anchor string, n int")).collect()
    assert sorted((r.chunk_id, r.anchor) for r in got) == sorted((i, a) for i, t in chunks if t for a in {a for a in found if a} if a in t)
    assert anchors.holding(df, spark.createDataFrame([], "anchor string")).collect() == [] and anchors.holding(df.limit(0), spark.createDataFrame([("a",)], "anchor string")).collect() == []


def test_table_functions(spark):
    """Pieces by LATERAL are those of the arrays; texts without any give no row."""
    kernels.register(spark)
    texts = [(1, "Satz eins. " * 90), (2, ""), (3, None), (4, "x" * 1200), (5, "a\n\nb")]
    df = spark.createDataFrame(texts, "id int, text string")
    got = spark.sql("select id, p.* from {df} t, lateral recursive_pieces(t.text, 500, 20) p", df=df).collect()
    assert sorted(map(tuple, got)) == sorted((i, k, p) for i, t in texts for k, p in enumerate(split.recursive_split(t or "", 500, 20)))
    html = "<table><tr><th>a</th></tr>" + "<tr><td>bcd</td></tr>" * 50 + "</table>"
    rows = spark.createDataFrame([(1, html, "p"), (2, None, None), (3, "<table></table>", None)], "id int, html string, prefix string")
    got = spark.sql("select id, p.text, p.row_start, p.row_end from {df} t, lateral table_pieces(t.html, t.prefix, 60) p", df=rows).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, p["text"], p["row_start"], p["row_end"]) for i, h, x in rows.collect() for p in tables.pieces(h, x, 60)), key=repr) and len(got) > 5


def plain_parse(html: str) -> tuple:
    """A table by its definition: every cell and caption is looked up for every row and text."""
    seen, depth, marks = tables._Tape(html).seen, 0, defaultdict(list)
    for i, (sign, tag) in enumerate(seen):
        if sign and tag == "table":
            depth = max(0, depth + (1 if sign == "+" else -1))
        elif sign and depth == 1:
            marks["cell" if tag in ("td", "th") else tag].append((i, sign))

    def closed(own, first):
        out, at = [], None
        for i, sign in own:
            if sign == "+":
                at = i if at is None or not first else at
            elif at is not None:
                out.append((at, i))
                at = None
        return out

    captions = closed(marks["caption"], True)
    dangling = [i for i, sign in marks["caption"] if sign == "+" and all(i > b for _, b in captions)][:1]
    hidden = captions + [(i, len(seen)) for i in dangling]
    text = lambda a, b: "".join(d for k, (sign, d) in enumerate(seen) if a <= k < b and not sign and not any(x < k < y for x, y in hidden)).strip()
    within = lambda tag, i: next((sign == "+" for k, sign in reversed(marks[tag]) if k < i), False)
    cells = [(b, text(a, b)) for a, b in closed([m for m in marks["cell"] if m[1] == "-" or within("tr", m[0])], False)]
    rows = [(within("thead", b), [t for at, t in cells if a < at < b]) for a, b in closed(marks["tr"], False)]
    head, body = ([c for inside, c in rows if c and inside == k] for k in (True, False))
    caption = "".join(d for sign, d in seen[slice(*captions[-1])] if not sign).strip() if captions else ""
    return (caption, head[0], body) if head else (caption, body[0] if body else [], body[1:])


def test_tables_in_linear_time():
    """Nested and unclosed tags at random against the definition; ten times the rows take about ten times as long."""
    rnd = random.Random(4)
    tags = "<table> </table> <tr> </tr> <td> </td> <th> </th> <thead> </thead> <tbody> </tbody> <caption> </caption> a b c".split()
    for _ in range(4000):
        html = rnd.choice(["<table>", ""]) + "".join(rnd.choice(tags) for _ in range(rnd.randint(0, 40)))
        t = tables.parse(html)
        assert (t.caption, t.headers, t.rows) == plain_parse(html), html

    def seconds(n: int) -> float:
        html = "<table><caption>x</caption>" + "<tr><td>a</td><td>b</td></tr>" * n + "</table>"
        took = []
        for _ in range(3):
            began = time.process_time()
            assert len(tables.pieces(html, "p", 10**9)) == 1
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(20_000) < 30 * seconds(2_000)


def test_remote_vectors(spark, tmp_path):
    """Requests are bounded, equal texts go once, failures are tried again and told by row."""

    def call(texts, timeout, log=str(tmp_path)):
        import os
        import random
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\x1e".join(texts))
        assert len(texts) <= 7 and timeout == 9.0 and not any("\n" in t for t in texts)
        if any(t == "refused" for t in texts):
            raise RuntimeError("refused")
        if random.Random(os.urandom(4)).random() < 0.3:
            raise TimeoutError("late")
        return [[] if t == "void" else [float(len(t)), 1.0] for t in texts]

    model = remote.Remote(call, texts_at_once=7, chars_at_once=200, timeout=9.0, retries=8, wait=0.001)
    rows = [(i, t) for i, t in enumerate([None, "", "refused", "void", "two\nlines", *("same" for _ in range(40)), *(f"text {k}" * (k % 9) for k in range(60)), "x" * 500])]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {r.id: r.v for r in df.select("id", model.vectors(F.col("text")).alias("v")).collect()}
    for i, t in rows:
        if t in ("refused", "void"):
            assert got[i].vector is None and (t if t == "refused" else "no vector") in got[i].error
        else:
            assert got[i].error is None and got[i].vector == (None if t is None else [float(len(t)), 1.0])
    sent = [p.read_text().split("\x1e") for p in tmp_path.iterdir()]
    assert all(sum(map(len, r)) <= 200 or len(r) == 1 for r in sent) and sum("same" in r for r in sent) <= 9 * 4
    with pytest.raises(Exception, match="refused"):
        df.where("id = 2").select(model(F.col("text"))).collect()
    good = df.where("id > 3").select("id", model(F.col("text")).alias("v"))
    assert {r.id: r.v for r in good.collect()} == {i: [float(len(t)), 1.0] for i, t in rows if i > 3}


def test_two_writers(spark, tmp_path):
    """Of two writers at once each gets a number of its own, and one of them a label."""
    chunks = spark.createDataFrame([("d", 0, "c", "text")], "doc_id string, chunk_index int, chunk_id string, chunk_text string")
    stores = [Store(spark, str(tmp_path / "s")) for _ in range(2)]
    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(lambda k: stores[k % 2].freeze(f"label {k}", chunks, F.current_timestamp()), range(6)))
        assert sorted(ids) == [*range(1, 7)]

        def same(k):
            try:
                return stores[k % 2].freeze("one", chunks, F.current_timestamp())
            except DuplicateLabel:
                return None

        assert sorted(x for x in pool.map(same, range(6)) if x) == [7]
    assert sorted(r.freeze_id for r in stores[0].read("freezes").collect()) == [*range(1, 8)]
    with pytest.raises(NoChunks):
        stores[0].freeze("later", chunks.limit(0), F.current_timestamp())
    assert stores[1].freeze("later", chunks, F.current_timestamp()) > 7


def test_batches_written_once(spark, tmp_path):
    """A batch that was written, but whose commit was lost, is run again and adds nothing."""
    rows = "created_at timestamp, total_ms double, is_empty_recall boolean"
    made = lambda a, b: spark.sql(f"select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as created_at, double(id) as total_ms, id % 2 = 0 as is_empty_recall from range({a}, {b})")
    live = lambda: spark.readStream.schema(rows).parquet(str(tmp_path / "in"))
    run = lambda: query_log.append_log(live(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    told = lambda: sorted(r.total_ms for r in spark.read.parquet(str(tmp_path / "out")).collect())
    made(0, 20).write.parquet(str(tmp_path / "in"))
    run()
    assert told() == [float(i) for i in range(20)]
    for f in (tmp_path / "cp" / "commits").iterdir():  # as if the driver had gone after the write
        f.unlink()
    run()
    assert told() == [float(i) for i in range(20)]
    made(20, 30).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert told() == [float(i) for i in range(30)]
    seen = {}
    query_log.trailing(live(), str(tmp_path / "cp2"), lambda batch, _: seen.update({r.window_end: r.query_count for r in batch.collect()}), 5).awaitTermination()
    # Rows come one a minute: each full window of five minutes holds five.
    assert sum(n == 5 for n in seen.values()) == 26 and sum(seen.values()) == 30 * 5


def test_only_chosen_files_are_opened(spark, tmp_path):
    """Files are chosen by name before any is read: a file that can't be read as text stands beside a chosen one; no contents are shuffled."""
    for folder, name, text in (("a", "x_content_list.json", '[{"type": "text", "text": "one"}]'), ("a", "y_v2.json", "[["), ("b [1]", "z_v2.json", '[[{"type": "paragraph", "content": {"paragraph_content": "two"}}]]'), ("c", "other.json", "{}")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    found = items.read_items(spark, str(tmp_path))
    assert len({r.doc_id for r in found.collect()}) == 2 and sorted(r.text for r in found.collect()) == ["one", "two"]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_passing_tables(spark):
    """Tables go once what was worked out of them is stored; others' tables stay."""
    other = shared.settled(spark.range(3), "other")
    passing = shared.Passing(spark)
    a = shared.settled(spark.range(5), "a")
    b = shared.settled(a.where("id > 1"), "b")
    passing.drop()
    assert b.count() == 3 and other.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist"):
        a.count()
    c = shared.settled(b.where("id > 2"), "c")
    passing.drop()
    assert c.count() == 2 and other.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist"):
        b.count()


def test_long_rows_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """A bucket of few but long rows isn't one task's; rows replaced in it neither; a small bucket stays one file."""
    monkeypatch.setattr(store_module, "IN_A_TASK", 2_000, raising=False)
    store = Store(spark, str(tmp_path / "store"))
    rows = lambda n, size: [(f"k{i % 7}", "é" * size, [float(i)] * 3) for i in range(n)]
    told = lambda n, size: spark.createDataFrame(rows(n, size), "k string, t string, v array<double>").repartition(3)
    files = lambda name: len(list((tmp_path / "store" / name / "_bucket=b").glob("*.parquet")))
    with spark_conf(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        assert sorted(map(tuple, store.replace("long", told(300, 100), "k").collect())) == sorted(rows(300, 100)) and files("long") > 1
        assert sorted(map(tuple, store.replace("long", told(200, 120), "k").collect())) == sorted(rows(200, 120)) and files("long") > 1
        assert store.replace("short", told(20, 2), "k").count() == 20 and files("short") == 1


@contextmanager
def spark_conf(spark, key, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    yield
    spark.conf.set(key, before)


def test_grams_that_leave_texts(spark):
    """Of texts only grams that may be keys go on, about as many as lines, however many grams the anchors have; frequent ones are no keys."""
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    chunks = [(i, "\n".join(["the same beginning of every line " + text(60) for _ in range(3)] + [text(20) for _ in range(3)])) for i in range(200)]
    df = spark.createDataFrame(chunks, "chunk_id long, chunk_text string")
    lines = df.select(F.explode(F.split("chunk_text", "\n")).alias("anchor"))
    keys = anchors._keyed(lines, anchors._frequent(df))
    held = anchors._listed(df, [anchors.LONG, anchors.MIDDLE], anchors._filter(keys, 1200))
    assert 1200 <= held.count() < 3000 and held.join(keys, "gram").count() < 1300
    assert anchors.holding(df, lines).count() == 1200


def test_a_task_gives_a_query_its_best_rows_alone(spark, monkeypatch):
    """Batches and blocks of any size, copies, excluded rows and scores that single precision can't tell apart give the first rows by score and id."""
    rnd = random.Random(7)
    base = [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    near = [[x * (1 + k * 1e-9) if j == 0 else x for j, x in enumerate(base[0])] for k in range(20)]
    rows = [(f"c{i:03}", v) for i, v in enumerate(base * 4 + near + [[0.0] * 4, None, [float("nan")] * 4, [1.0] * 3] + [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(60)])]
    index = spark.createDataFrame(rows, "chunk_id string, vector array<double>").coalesce(1)
    queries = [{"query_id": i, "vector": v, "exclude": f"c{i:03}" if i % 2 else None} for i, v in enumerate(base)]

    def best(q):
        cosine = lambda v: float(np.einsum("i,i->", np.array(q["vector"]), np.array(v)) / (np.sqrt((np.array(q["vector"]) ** 2).sum()) * np.sqrt((np.array(v) ** 2).sum())))
        good = [(c, cosine(v)) for c, v in rows if v and len(v) == 4 and any(v) and v[0] == v[0] and c != q["exclude"]]
        return sorted(good, key=lambda r: (-r[1], r[0]))[:5]

    for at_once, size in ((4_000_000, 10_000), (30, 7)):
        monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", at_once)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = retrieval._scored(index, queries, 5, "long").collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == 5 * len(queries)
        for q in queries:
            own = sorted(((r.chunk_id, r.score) for r in got if r.query_id == q["query_id"]), key=lambda r: (-r[1], r[0]))
            assert [s for _, s in own] == pytest.approx([s for _, s in best(q)], abs=1e-12)
            assert len({c for c, _ in own}) == 5 and q["exclude"] not in {c for c, _ in own}
            assert q["query_id"] == 0 or [c for c, _ in own][:3] == [c for c, _ in best(q)][:3]


def test_anchors_of_near_copies(spark):
    """Near copies share an anchor's key without holding it: what is told of such a pair doesn't grow with the anchor's length."""
    rnd = random.Random(9)
    words = [rnd.choice("abcdefghij") * 3 + rnd.choice("klmnop") + str(rnd.randrange(99)) for _ in range(800)]
    texts = [" ".join(w if i != 13 * k % 800 else f"edit{k}" for i, w in enumerate(words)) for k in range(40)]
    df = spark.createDataFrame([(k, f"before {t} after" + " and again " * (k % 3) + t * (k % 2)) for k, t in enumerate(texts)], "chunk_id long, chunk_text string")
    lines = spark.createDataFrame([(t,) for t in [*texts, texts[0], None, "", "ab", "edit7", texts[3][:33]]], "anchor string")
    keys = anchors._keyed(lines, (np.zeros(0, np.int64), np.zeros(0, np.int64)))  # as of texts that aren't in the sample
    assert not any(kind == "string" for _, kind in [*keys.dtypes, *anchors.found(df, lines).dtypes])
    pairs = anchors._listed(df, [anchors.LONG], anchors._filter(keys, 44)).join(keys.distinct(), "gram")
    assert pairs.count() > 200 and max(len(repr(tuple(r))) for r in pairs.collect()) < 250
    got = sorted((r.chunk_id, r.anchor) for r in anchors.holding(df, lines).collect())
    assert got == sorted((r.chunk_id, a) for r in df.collect() for a in {a.anchor for a in lines.collect() if a.anchor} if a in r.chunk_text)


def test_tables_in_whole_batches(spark, monkeypatch):
    """A table function takes batches of tables and gives what each gives alone; order_table_pieces goes through it."""
    kernels.register(spark)
    cell = ["a", " é  b ", "x > y", "1 &amp; 2", "<b>c</b>", "", "long " * 30]
    rnd = random.Random(11)
    rows = [(i, "<table>" + rnd.choice(["", "<caption> C </caption>"]) + "<tbody>" + "".join("<tr>" + "".join(f"<td>{rnd.choice(cell)}</td>" for _ in range(rnd.randrange(4))) + "</tr>" for _ in range(rnd.randrange(9))) + "</tbody></table>", rnd.choice([None, "p"])) for i in range(300)]
    rows += [(300, None, None), (301, "", "p"), (302, "no table", "p")]
    df = spark.createDataFrame(rows, "table_id long, html string, prefix string").coalesce(1)
    got = spark.sql("SELECT * FROM pieces_of_tables(TABLE({t}), 90)", t=df).collect()
    assert sorted(map(tuple, got)) == [(i, pos, *p.values()) for i, h, x in rows for pos, p in enumerate(tables.pieces(h, x, 90))]
    assert "pieces_of_tables" in queries.QUERIES["order_table_pieces"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_plain_tables():
    """Tables that one expression tells apart are what the parser makes of them, and a large one takes no longer than in proportion."""
    rnd = random.Random(12)
    bits = ["<table>", "</table>", "<caption>", "</caption>", "<thead>", "</thead>", "<tbody>", "</tbody>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>"]
    row = lambda: "<tr>" + "".join(f"<t{k}>{rnd.choice(['', ' a ', 'b > c', chr(160), 'é|'])}</t{k}>" for k in rnd.choices("dh", k=rnd.randrange(4))) + "</tr>"
    plain = 0
    for _ in range(3000):
        html = "<table>" + rnd.choice(["", "<caption> C\n</caption>", "<caption></caption>"]) + rnd.choice(["", f"<thead>{row()}{row()}</thead>", "<thead></thead>"]) + "<tbody>" + "".join(row() for _ in range(rnd.randrange(4))) + "</tbody></table>"
        if rnd.random() < 0.5:
            at = rnd.randrange(len(html))
            html = html[:at] + rnd.choice([*bits, "&lt;", "x", "<", " "]) + html[at:]
        told = tables._plain(html)
        plain += told is not None
        assert told in (None, tables._parsed(html)), html
    assert plain > 1500
    began = time.time()
    assert len(tables.parse("<table><tbody>" + "<tr><td>a</td><th>b</th></tr>" * 200_000 + "</tbody></table>").rows) == 199_999
    assert time.time() - began < 5
