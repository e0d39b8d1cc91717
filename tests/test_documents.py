"""Extraction, chunking, stores, the service and the log stream."""

from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from lodestack.operators import evaluate, extract
from lodestack.operators.chunk import BLOCK, ChunkSettings, chunk_documents, title_paths, without_chunks
from lodestack.plans.service import CASE, Service, ServiceError
from lodestack.sources import shared
from lodestack.sources.items import items_of, read_items
from lodestack.sources.store import Store
from lodestack.streaming import query_log

TABLE = "<table><thead><tr><th>名称</th><th>数量</th></tr></thead><tbody><tr><td>{}</td><td>一</td></tr></tbody></table>"
FLAT = [
    {"type": "text", "text": "1.总 则", "text_level": 1, "page_idx": 0},
    {"type": "text", "text": "本办法适用于全体员工。", "page_idx": 0, "bbox": [0, 0, 1, 1]},
    {"type": "text", "text": "全体员工。", "page_idx": 0},
    {"type": "text", "text": "页脚文字"},
    {"type": "list", "list_items": ["第一项内容说明", "  ", {"text": "第二项内容说明"}], "page_idx": 1},
    {"type": "table", "table_body": TABLE.format("甲"), "table_caption": ["表1"], "page_idx": 1},
    {"type": "table", "table_body": TABLE.format("乙"), "page_idx": 2},
    {"type": "header", "text": "x"},
    {"type": "text", "text": "short english line here", "page_idx": -1},
    {"type": "text", "text": "页脚文字"},
    "junk",
]
PAGED = [[{"type": "title", "content": {"title_content": [{"content": "标题"}], "level": 1}}, {"type": "paragraph", "content": {"paragraph_content": [{"content": "正文"}, {"children": [{"content": "内容在此。"}]}]}}], [{"type": "list", "content": {"list_items": ["甲方条款说明", [{"content": "乙方条款说明"}]]}}, {"type": "image"}]]


@pytest.fixture(scope="module")
def extracted(spark):
    texts = spark.createDataFrame([("f", json.dumps(FLAT, ensure_ascii=False)), ("p", json.dumps(PAGED, ensure_ascii=False)), ("e", "[]")], "doc_id string, json string")
    return extract.extract(items_of(texts))


def test_blocks(extracted):
    blocks = extracted[1].where("doc_id = 'f'").orderBy("order").collect()
    assert [(b.type, b.text) for b in blocks[:4]] == [("title", "1. 总则"), ("paragraph", "本办法适用于全体员工。"), ("list_item", "第一项内容说明"), ("list_item", "第二项内容说明")]
    assert blocks[4].html.count("<td>") == 4 and (blocks[4].logical_table_id, blocks[4].page_idx, blocks[4].n_merged) == ("tbl-000", 1, 1)
    assert blocks[1].bbox == [0, 0, 1, 1] and len(blocks) == 5


def test_report(extracted):
    told = {r.doc_id: r for r in extracted[0].collect()}
    f = told["f"]
    assert (f.dropped_fragments, f.dropped_garbled, f.dropped_elements, f.table_merged_count, f.page_count) == (1, 1, 5, 1, 3)
    assert told["p"].full_text == "标题\n\n正文内容在此。\n\n甲方条款说明\n\n乙方条款说明"


def test_files(spark, tmp_path):
    for name, text in (("a/x_content_list.json", FLAT), ("a/x_v2.json", PAGED), ("b/y_v2.json", PAGED)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(text, ensure_ascii=False))
    assert {r[0]: r[1] for r in read_items(spark, str(tmp_path)).groupBy("doc_id").count().collect()} == {"a": 10, "b": 3}


def test_places_of_many_items(spark):
    """Over 21,475 items in a flat list, and over 100,000 on a page before another one, stay in order."""
    flat = [{"type": "text", "text": str(i)} for i in range(21_480)]
    page = [{"type": "paragraph", "content": {"paragraph_content": str(i)}} for i in range(100_002)]
    texts = spark.createDataFrame([("f", json.dumps(flat)), ("p", json.dumps([page[:-1], page[-1:]]))], "doc_id string, json string")
    found = items_of(texts).select("doc_id", "pos", F.col("text").cast("int").alias("i")).collect()
    for doc, n in (("f", len(flat)), ("p", len(page))):
        rows = sorted((r.pos, r.i) for r in found if r.doc_id == doc)
        assert [i for _, i in rows] == list(range(n)) and len({p for p, _ in rows}) == n


def test_deep_spans(spark):
    """Text stands at any depth; content that is a string goes before children."""

    def nested(depth):
        return [{"content": f"t{depth}"}] if not depth else [{"children": nested(depth - 1)}, f"s{depth}"]

    want = lambda depth: "t0" + "".join(f"s{k}" for k in range(1, depth + 1))
    content = {"paragraph_content": nested(5)}, {"title_content": nested(300), "level": 2}, {"list_items": [nested(6), {"content": "a", "children": ["b"]}, 1.50, " "]}, {}
    page = [{"type": t, "content": c} for t, c in zip(("paragraph", "title", "list", "paragraph"), content, strict=True)]
    items = items_of(spark.createDataFrame([("p", json.dumps([page]))], "doc_id string, json string")).orderBy("pos").collect()
    assert [i.text for i in items] == [want(5), want(300), None, ""] and items[2].list_items == [want(6), "a", "1.5"]


def test_suffix_copies_at_far_places(spark):
    nodes = [("d", (30_000 << 32) + k, 0, "paragraph", t, None) for k, t in enumerate(("本办法适用于全体员工。", "全体员工。"))]
    nodes = spark.createDataFrame(nodes, "doc_id string, pos long, sub int, type string, text string, dropped string")
    assert [r.dropped for r in extract._without_suffix_copies(nodes).orderBy("pos").collect()] == [None, "fragment"]


def test_title_paths(spark):
    titles = [("Doc", 1), ("1. One", 1), ("1.1 Two", 1), ("2 Three", 1), ("plain", None)]
    df = spark.createDataFrame([(titles,)], "t array<struct<title:string,level:int>>")
    assert df.select(title_paths(F.col("t"))).first()[0] == [["Doc"], ["Doc", "1. One"], ["Doc", "1. One", "1.1 Two"], ["Doc", "2 Three"], ["Doc", "2 Three", "plain"]]


def test_chunks(spark):
    rows = [
        ("a", 0, "title", "Doc", None, None, 0, [1.0, 2.0, 3.0, 4.0], 1), ("a", 1, "title", "1. One", None, None, 0, None, 1), ("a", 2, "paragraph", "body text " * 10, None, None, 1, None, None),
        ("a", 3, "title", "1.1 T", None, None, 1, None, 1), ("a", 4, "table", None, TABLE.format("x"), "tbl-000", 2, None, None), ("a", 5, "paragraph", "tail after table.", None, None, 2, None, None), ("a", 6, "title", "2 Two", None, None, 3, None, 1),
    ]
    docs = spark.createDataFrame([("a", "x"), ("b", "hello. world " * 100), ("c", " ")], "doc_id string, full_text string")
    chunks = chunk_documents(docs, spark.createDataFrame(rows, BLOCK), ChunkSettings())
    a = chunks.where("doc_id = 'a'").orderBy("chunk_index").collect()
    assert [c.chunk_text.split("\n")[0] for c in a] == ["Doc", "1.1 T", "tail after table.", "2 Two"]
    assert [c.full_section_path for c in a] == [["Doc", "1. One"], ["Doc", "1. One", "1.1 T"], ["Doc", "1. One", "1.1 T"], ["Doc", "2 Two"]]
    assert [(c.page_num, c.page_end, c.is_cross_page) for c in a] == [(1, 2, True), (3, 3, False), (3, 3, False), (4, 4, False)]
    assert [(c.prev_chunk_index, c.next_chunk_index) for c in a] == [(None, 1), (0, 2), (1, 3), (2, None)]
    assert (a[1].chunk_kind, a[1].table_cols, a[1].table_row_start, a[0].bbox, a[0].parent_section) == ("table_rows", 2, 0, [1.0, 2.0, 3.0, 4.0], "Doc")
    assert {c.chunk_kind for c in chunks.where("doc_id = 'b'").collect()} == {"full_text_fallback"}
    assert [r[0] for r in without_chunks(docs, chunks).collect()] == ["c"]


def test_evidence_keys(spark):
    chunks = spark.createDataFrame([("c1", "d1", 0, "the anchor text stands here", "AB"), ("c2", "d2", 0, "the anchor text stands here", "CD")], "chunk_id string, doc_id string, chunk_index int, chunk_text string, content_hash string")
    keys = [("k1", 0, "anchor text", "d1", None), ("k2", 0, None, None, "cd"), ("k3", 0, "the anchor text stands", None, None), ("k4", 0, "anchor", None, None), ("k5", 0, "absent words in no chunk", None, None)]
    keys = spark.createDataFrame(keys, "case_id string, key_pos int, anchor_text string, doc_id string, content_hash string")
    found = {r[0]: r[1] for r in evaluate.resolved_ids(evaluate.evidence_pairs(keys, chunks)).collect()}
    assert found == {"k1": ["c1"], "k2": ["c2"], "k3": ["c1", "c2"], "k4": ["c1", "c2"]}


def test_scores(spark):
    cases = [("ids", ["c1", "c2"], None, "any", True), ("words", None, ["ANCHOR"], "any", True), ("all", None, ["anchor", "absent"], "all", True), ("negative", ["c9"], None, "any", False), ("empty", ["c1"], None, "any", True)]
    cases = spark.createDataFrame(cases, "case_id string, relevant_chunk_ids array<string>, expected_keywords array<string>, keyword_match_mode string, expect_hit boolean")
    rows = [(c, k, i, t) for c in ("ids", "words", "all", "negative") for k, i, t in ((1, "c8", "nothing"), (2, "c1", "an anchor"))]
    told = evaluate.score_cases(cases, spark.createDataFrame(rows, "case_id string, rank int, chunk_id string, chunk_text string"))
    assert {r.case_id: (r.hit, r.recall, r.mrr) for r in told.collect()} == {"ids": (1, 0.5, 0.5), "words": (1, 0.0, 0.5), "all": (0, 0.0, 0.0), "negative": (1, 0.0, 0.0), "empty": (0, 0.0, 0.0)}


def test_scores_of_pairs(spark):
    """Relevance in rows scores as id lists do."""
    ids = {"some": ["1", "2", "3"], "none": [], "negative": ["9"], "empty": ["1"], "late": ["8"]}
    lists = [(c, v, None, "any", c != "negative") for c, v in ids.items()]
    lists = spark.createDataFrame(lists, "case_id string, relevant_chunk_ids array<string>, expected_keywords array<string>, keyword_match_mode string, expect_hit boolean")
    rows = spark.createDataFrame([(c, k, i, "") for c in ids if c != "empty" for k, i in ((1, 1), (2, 3), (3, 8))], "case_id string, rank int, chunk_id long, chunk_text string")
    counts = spark.createDataFrame([(c, len(v), c != "negative") for c, v in ids.items()], "case_id string, n_ids long, expect_hit boolean")
    pairs = spark.createDataFrame([(c, int(i)) for c, v in ids.items() for i in v + v], "case_id string, chunk_id long")
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(evaluate.score_pairs(counts, pairs, rows)) == told(evaluate.score_cases(lists, rows))


def test_service(spark, tmp_path, extracted):
    service = Service(spark, Store(spark, str(tmp_path / "store")), min_score=0.0)
    texts = spark.createDataFrame([("f", json.dumps(FLAT, ensure_ascii=False)), ("p", json.dumps(PAGED, ensure_ascii=False))], "doc_id string, json string")
    queries = spark.createDataFrame([("q", "全体员工适用的办法")], "query_id string, query_text string")
    with pytest.raises(ServiceError) as e:
        service.query(queries)
    assert e.value.code == "INDEX_NOT_READY"
    assert service.extract(items_of(texts)).count() == 2
    with pytest.raises(ServiceError, match="x"):
        service.chunk(["f", "x"])
    n = service.chunk(["f", "p"]).count()
    service.chunk(["f"])
    assert service.build_index().count() == n
    first = service.query(queries, 2).orderBy("rank").first()
    assert first.doc_id == "f" and first.rank == 1
    assert service.metrics().first()["query_count"] == 2 and service.health().first()["index_ready"]
    cases = spark.createDataFrame([("c", "全体员工", None, None, [("本办法适用于全体员工", None, None)], "any", 3, True, True, None), ("c", "全体员工适用", None, ["全体员工"], None, "any", 3, True, True, None)], CASE)
    service.upsert_cases(cases.withColumn("at", F.monotonically_increasing_id()), "at")
    run = service.run_eval().first()
    assert (run.dataset_size, run.avg_hit, run.top_k) == (1, 1.0, 3) and service.runs().count() == 1
    freeze = service.freeze("one")
    assert service.freeze_detail(freeze)[1].count() == n
    for wrong, code in ((lambda: service.freeze("one"), "DUPLICATE_FREEZE_LABEL"), (lambda: service.freeze_detail(9), "CHUNK_FREEZE_NOT_FOUND"), (lambda: service.query(queries, 99), "VALIDATION_ERROR")):
        with pytest.raises(ServiceError) as e:
            wrong()
        assert e.value.code == code


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """A store with chunks of two documents, with metadata, and its index."""
    path = tmp_path_factory.mktemp("built")
    service = Service(spark, Store(spark, str(path)), min_score=0.0)
    texts = [("f", json.dumps(FLAT, ensure_ascii=False)), ("p", json.dumps(PAGED, ensure_ascii=False))]
    told = spark.createDataFrame([("f", "f.pdf", '{"category": "law", "level": 2}'), ("p", "p.pdf", '{"category": "note", "access_group": ["ops"]}')], "doc_id string, file_path string, metadata string")
    docs = service.extract(items_of(spark.createDataFrame(texts, "doc_id string, json string")), told)
    totals = service.extract_totals(docs).first(), service.chunk_totals(["f", "p", "f"], service.chunk(["f", "p", "f"])).first()
    service.build_index()
    return path, totals


@pytest.fixture
def service(spark, tmp_path, built):
    """A service of its own on a copy of that store."""
    shutil.copytree(built[0], tmp_path / "store")
    service = Service(spark, Store(spark, str(tmp_path / "store")), min_score=0.0)
    service.index, service.totals = service.store.read("index"), built[1]
    return service


def test_metadata_reaches_the_filter(spark, service):
    asked = spark.createDataFrame([("q", "全体员工适用的办法"), ("r", "标题")], "query_id string, query_text string")
    of = lambda filters, q="q": {r.doc_id for r in service.query(asked, 20, filters).where(f"query_id = '{q}'").collect()}
    assert of(None) == {"f", "p"} and of({"category": "law"}) == {"f"} and of({"level": None}) == {"p"} and of({"level": 2.0}) == {"f"}
    assert of({"access_group": ["ops"], "file_path": "p.pdf"}) == {"p"} and of({"access_group": ["rd"]}, "r") == {"f"} and of({"absent": 1}) == set()
    logs = service.store.read("query_logs").collect()
    assert len(logs) == 14 and all(r.total_ms >= r.embed_ms + r.retrieve_ms > 0 for r in logs) and sum(r.is_empty_recall for r in logs) == 2 and sum(r.filters_applied for r in logs) == 12
    docs, chunks = service.totals
    assert (docs.extracted_doc_count, docs.total_page_count, chunks.stored_doc_count) == (2, 5, 3) and chunks.stored_chunk_count > service._chunks().count()


def test_runs_keep_items_and_filters(spark, service):
    ids = {r.doc_id: r.chunk_id for r in service._chunks().where("chunk_index = 0").collect()}
    cases = [("any", " 全体员工 ", None, ["全体员工"], None, None, None, True, None, None), ("other", "全体员工", None, ["全体员工"], None, "any", 2, True, True, '{"category": "note"}'), ("gone", "标题", [ids["p"]], None, None, "any", 2, True, True, '{"category": "note"}')]
    service.upsert_cases(spark.createDataFrame(cases, CASE).withColumn("at", F.lit(0)), "at")
    run = service.run_eval().first()
    items = {r.case_id: r for r in service.run_items(run.run_id).collect()}
    assert (items["any"].hit, items["other"].hit, items["gone"].hit, items["gone"].recall) == (1, 0, 1, 1.0)
    assert ids["p"] in items["gone"].retrieved_chunk_ids and all(r.latency_ms > 0 and r.query_text for r in items.values())
    assert run.avg_latency_ms == pytest.approx(sum(r.latency_ms for r in items.values()) / 3) and run.top_k == 2 and run.dataset_size == 3


def test_failures_have_codes_and_are_logged(spark, service):
    asked = spark.createDataFrame([("q", "全体员工")], "query_id string, query_text string")
    code = lambda f: pytest.raises(ServiceError, f).value.code
    service.vectorise = lambda text: F.raise_error(F.lit("no model"))
    assert code(lambda: service.query(asked)) == "QUERY_EXECUTION_ERROR" and code(service.build_index) == "INDEX_BUILD_ERROR"
    assert [r.error_code for r in service.store.read("query_logs").collect()] == ["QUERY_EXECUTION_ERROR"]
    assert code(lambda: service.query(spark.createDataFrame([("q", " ")], "query_id string, query_text string"))) == "VALIDATION_ERROR"
    assert code(lambda: service.chunk([])) == code(lambda: service.chunk([" "])) == code(lambda: service.freeze(" ")) == code(lambda: service.metrics(0)) == code(lambda: service.runs(0)) == "VALIDATION_ERROR"
    assert code(lambda: service.chunk(["f", "x"])) == "DOCUMENT_NOT_EXTRACTED" and code(service.run_eval) == "EVAL_DATASET_EMPTY"
    case = lambda **k: spark.createDataFrame([tuple(({"case_id": "c", "query_text": "t", "expected_keywords": ["k"]} | k).get(c.split(" ")[0]) for c in CASE.split(", "))], CASE).withColumn("at", F.lit(0))
    for wrong in ({"case_id": " "}, {"query_text": None}, {"expected_keywords": None}, {"expected_keywords": [" "]}, {"top_k": 21}, {"keyword_match_mode": "some"}, {"filters": "[1]"}, {"evidence_keys": [(" ", "d", None)]}):
        assert code(lambda wrong=wrong: service.upsert_cases(case(**wrong), "at")) == "VALIDATION_ERROR", wrong
    service.store.read = lambda *_: 1 / 0
    assert (code(service.metrics), code(service.cases), code(service.runs), code(service.freezes), code(lambda: service.freeze_detail(1)), code(lambda: service.freeze("l"))) == (
        "METRICS_READ_ERROR", "EVAL_DATASET_READ_ERROR", "EVAL_RUNS_READ_ERROR", "CHUNK_FREEZE_LIST_ERROR", "CHUNK_FREEZE_READ_ERROR", "CHUNK_FREEZE_CREATE_ERROR")


def test_a_log_that_fails_doesnt_fail_the_query(spark, service):
    service.store.append = lambda *_: 1 / 0
    assert service.query(spark.createDataFrame([("q", "全体员工")], "query_id string, query_text string")).count() == 3


def test_items_without_head_belong_to_no_snapshot(spark, service):
    """A freeze that fails before its head is written leaves nothing behind for the next one."""
    append = service.store.append
    service.store.append = lambda name, rows: append(name, rows) if name != "freezes" else 1 / 0
    assert pytest.raises(ServiceError, service.freeze, "one").value.code == "CHUNK_FREEZE_CREATE_ERROR"
    service.store.append = append
    freeze = service.freeze("one", ["p"], pipeline_version="v1")
    head, items = service.freeze_detail(freeze)
    assert freeze == 2 and {r.doc_id for r in items.collect()} == {"p"} and head.first().pipeline_version == "v1" and service.freezes().count() == 1


def test_embedded_metadata(spark, service):
    service.embed_metadata, service.index_source = True, "store"
    before = {r.chunk_id: r.vector for r in service.index.collect()}
    after = service.build_index().collect()
    assert {r.source for r in after} == {"store"} and all(r.vector != before[r.chunk_id] for r in after)


def test_buckets_grow(spark, tmp_path, monkeypatch):
    """Buckets split as the table grows, each write touches those of its keys, and a split that was broken off changes nothing."""
    monkeypatch.setattr("lodestack.sources.store.IN_A_BUCKET", 40)
    keyed, want = Store(spark, str(tmp_path)), {}
    files = lambda: {str(p) for p in (tmp_path / "t").rglob("*.parquet")}

    def put(rows):
        keyed.replace("t", spark.createDataFrame(rows, "doc_id string, v string"), "doc_id")
        for k in {k for k, _ in rows}:
            want[k] = sorted(v for x, v in rows if x == k)
        got = {}
        for r in keyed.read("t").collect():
            got.setdefault(r.doc_id, []).append(r.v)
        assert {k: sorted(v) for k, v in got.items()} == want

    put([(str(i), "a") for i in range(30)])
    assert keyed.buckets("t") == (["b"], [])
    for n in range(1, 6):
        put([(str(i), f"{n}") for i in range(100 * n, 100 * n + 150)])
    live, dead = keyed.buckets("t")
    sizes = dict(map(tuple, spark.read.parquet(str(tmp_path / "t")).groupBy("_bucket").count().collect()))
    assert len(live) > 16 and not dead and max(sizes.values()) <= 40
    before = files()
    put([("107", "b"), ("107", "c"), ("x", "d")])
    assert 0 < len(before - files()) <= 2
    put([("hot", str(i)) for i in range(200)])  # one key's rows can't be split, but by several tasks
    put([("hot", "left")])
    put([(str(i), "all") for i in range(700)])
    # Parts of a split whose mark was never set don't count, and go with the next write.
    b = keyed.buckets("t")[0][0]
    spark.createDataFrame([("ghost", "z")], "doc_id string, v string").write.parquet(str(tmp_path / "t" / f"_bucket={b}0"))
    assert keyed.buckets("t")[1] == [f"{b}0"] and "ghost" not in {r.doc_id for r in keyed.read("t").collect()}
    put([("new", "n")])
    assert keyed.buckets("t")[1] == []
    assert keyed.replace("t", spark.createDataFrame([], "doc_id string, v string"), "doc_id").count() == sum(map(len, want.values()))


def test_stream(spark, tmp_path):
    rows = "created_at timestamp, total_ms double, is_empty_recall boolean"
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as created_at, double(id) as total_ms, id % 2 = 0 as is_empty_recall from range(20)").write.parquet(str(tmp_path / "in"))
    query_log.append_log(spark.readStream.schema(rows).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    told = query_log.tumbling(stored, "5 minutes").orderBy("window_start").collect()
    assert [(r.query_count, r.max_total_ms) for r in told] == [(5, 4.0), (5, 9.0), (5, 14.0), (5, 19.0)]
    live = query_log.tumbling(spark.readStream.schema(rows).parquet(str(tmp_path / "in")), "5 minutes", "1 minute")
    live.writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("closed").count() >= 3


def test_extraction_shuffles_texts_twice(spark, monkeypatch):
    """Once to gather a document's nodes, once to number what is left: copies are counted where nodes are gathered, tables told apart without texts."""
    plans = []
    monkeypatch.setattr(extract, "settled", lambda df, name="table": (plans.append((name, df)), shared.settled(df, name))[1])
    rows = [("d", i, kind, text, table) for i, (kind, text, table) in enumerate([("text", "第一段文字在这里。", None), ("table", None, "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>"), ("table", None, "<table><tr><th>a</th></tr><tr><td>2</td></tr></table>"), ("text", "重复的一行", None), ("text", "重复的一行", None), ("text", "最后一段文字也在。", None)])]
    null = F.lit(None)
    items = spark.createDataFrame(rows, "doc_id string, pos long, type string, text string, table_body string").withColumns({
        "text_level": null.cast("string"), "list_items": null.cast("array<string>"), "html": null.cast("string"), "table_caption": null.cast("array<string>"), "page_idx": null.cast("string"), "bbox": null.cast("array<double>"),
    })
    blocks = extract.extract(items)[1].orderBy("order").collect()
    assert [r.order for r in blocks] == list(range(len(blocks))) and [r.type for r in blocks if r.type != "table"] == ["paragraph"] * 3
    nodes = next(df for name, df in plans if name == "clean-nodes")
    assert nodes._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
