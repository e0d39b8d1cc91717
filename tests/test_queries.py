"""Every query against its SQL on the smallest tables, or that it gives rows."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack.operators import retrieval
from lodestack.plans.service import Service
from lodestack.queries import ORACLE_SQL, QUERIES
from lodestack.sources import store

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got or name in ("fetch_cases_by_id", "fetch_no_documents")
    if name in ORACLE_SQL:
        told = duck.sql(ORACLE_SQL[name])
        assert sorted(told.columns) == columns
        assert got == sorted(map(repr, told.project(", ".join(f'"{c}"' for c in columns)).fetchall()))


@pytest.mark.parametrize("name", ["eval_hit_recall_mrr", "eval_negative", "eval_run_summary"])
def test_relevance_is_not_gathered(spark, name):
    """A label's ids stay rows: as one list, a hot label's would have to fit into a task."""
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


@pytest.mark.parametrize("name", ["order_tables", "order_table_pieces"])
def test_equal_lines_of_orders(spark, tmp_path, name):
    """Lines that the SQL's order leaves open stand as in the file, as DuckDB's single thread takes them; quantities are rounded."""
    c = duckdb.connect()
    c.execute("set threads = 1")
    c.execute(f"""copy (select i // 8 as l_orderkey, 7 as l_partkey, (1 + i % 2)::int as l_linenumber, (i * 5 % 3 // 2 + 2.5 + i // 8)::double as l_quantity,
        substr('RNA', (1 + i * 7 % 3)::int, 1) as l_returnflag, substr('OF', (1 + i * 3 % 5 % 2)::int, 1) as l_linestatus from range(400) t(i)) to '{tmp_path}/lineitem.parquet'""")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = c.sql(ORACLE_SQL[name]).fetchall()
    got = QUERIES[name](spark, str(tmp_path)).select("table_id", "pos", "text", "row_start", "row_end", "cols").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["order_tables", "order_table_pieces"])
def test_marks_in_orders(spark, tmp_path, name):
    """Flags that look like tags or entities are text in the cells, as in SQL."""
    c = duckdb.connect()
    c.execute(f"""copy (select i // 4 as l_orderkey, i as l_partkey, (1 + i % 4)::int as l_linenumber, i::double as l_quantity, ['R', '<b>', 'a & b', '&lt;', '</td>', 'x|y'][1 + i % 6] as l_returnflag,
        ['O', '', '<tr>', '&amp;', '>'][1 + i % 5] as l_linestatus from range(240) t(i)) to '{tmp_path}/lineitem.parquet'""")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = QUERIES[name](spark, str(tmp_path)).select("table_id", "pos", "text", "row_start", "row_end", "cols").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(ORACLE_SQL[name]).fetchall())


def test_query_log_has_all_turns(spark, tmp_path):
    """Turns of every conversation are asked, not those of each fiftieth alone."""
    turns = [(c, t, role, f"what of {c} and {t}") for c in range(1, 4) for t, role in enumerate(("user", "assistant", "user"))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, f"text {i}", "en", "s") for i in range(5)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    told = QUERIES["service_query_log"](spark, str(tmp_path)).collect()
    assert sorted(r.query_text for r in told) == sorted(t[3] for t in turns if t[2] == "user")
    assert {(r.retrieved_before_filter, r.retrieved_after_filter) for r in told} == {(5, 3)}


def test_fetched_rows_have_no_texts(spark, tmp_path, monkeypatch):
    """Texts come with what is left of a query's rows, not with all that were fetched, unless a filter asks for them."""
    seen, fetched = [], retrieval.fetched
    monkeypatch.setattr(retrieval, "fetched", lambda asked, index, k: (seen.append("chunk_text" in index.columns), fetched(asked, index, k))[1])
    service = Service(spark, store.Store(spark, f"{tmp_path}/store"), min_score=0.0)
    chunks = spark.createDataFrame([(f"c{i}", "d", i, f"text {i}", '{"lang": "en"}') for i in range(4)], "chunk_id string, doc_id string, chunk_index int, chunk_text string, metadata string")
    service.store.replace("chunks", chunks, "doc_id")
    service.build_index()
    asked = spark.createDataFrame([("q", "text 2")], "query_id string, query_text string")
    found = [service.query(asked, 4, f) for f in ({"lang": "en"}, {"chunk_text": "text 2"})]
    assert seen == [False, True] and found[0].columns == found[1].columns
    assert {(r.chunk_id, r.chunk_text) for r in found[0].collect()} == {(f"c{i}", f"text {i}") for i in range(4)} and [r.chunk_id for r in found[1].collect()] == ["c2"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_comes_after_the_fetch(spark):
    """Rows that fit but rank beyond the over-fetch aren't found; a row without the key fits a null filter."""
    rows = [(i, [1.0, i / 100], "a" if i < 3 else "b" if i < 9 else None) for i in range(12)]
    index = spark.createDataFrame(rows, "chunk_id long, vector array<double>, kind string")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    found = lambda kind: [r.chunk_id for r in retrieval.retrieve(asked, index, 2, retrieval.matches({"kind": kind}, index.columns)).orderBy("rank").collect()]
    assert found("a") == [0, 1] and found("b") == [3, 4] and found(None) == []
    assert [r.chunk_id for r in retrieval.retrieve(asked, index, 4, retrieval.matches({"kind": None}, index.columns)).collect()] == [9, 10, 11]


@pytest.mark.parametrize(("filters", "found"), [
    ({}, "abcd"), ({"kind": "x"}, "ab"), ({"absent": None}, "abcd"), ({"absent": 1}, ""), ({"page": 1}, "ab"), ({"page": True}, "ab"), ({"page": 1.0, "kind": "x"}, "ab"), ({"page": "1"}, ""), ({"page": None}, "d"),
    ({"groups": ["rd"]}, "a"), ({"groups": ["ops", "rd"]}, ""), ({"own": "k"}, "a"), ({"own": None}, "bcd"), ({"kind": "z"}, ""), ({"it's": [1, {"b": 2}]}, "b"),
])
def test_filters(spark, filters, found):
    """Columns come first, then keys of the metadata; a missing key equals null, numbers equal numbers and truth values, lists a whole list."""
    rows = [("a", "x", 1, ["rd"], '{"own": "k", "kind": "z"}'), ("b", "x", 1, ["rd", "ops"], '{"it\'s": [1, {"b": 2}]}'), ("c", "y", 2, None, "[1]"), ("d", None, None, [], None)]
    df = spark.createDataFrame(rows, "chunk_id string, kind string, page int, groups array<string>, metadata string")
    condition = retrieval.matches(filters, df.columns)
    assert "".join(sorted(r[0] for r in (df if condition is None else df.where(condition)).collect())) == found
    per_row = df.withColumn("f", F.to_json(F.struct(F.lit("x").alias("kind")))).where(retrieval.fits(retrieval.filters_of(F.col("f")), retrieval.values_of(df.columns)))
    assert per_row.count() == 2


def test_blocks_of_queries(spark, monkeypatch):
    """Queries in many blocks, and of several lengths, find what they find in one."""
    rnd = random.Random(4)
    vectors = lambda n, size: [(i + 1000 * size, [rnd.gauss(0, 1) for _ in range(size)]) for i in range(n)]
    index = spark.createDataFrame(vectors(60, 3) + vectors(50, 5) + [(7, None), (8, [0.0] * 3)], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(str(i), v) for i, v in vectors(9, 3) + vectors(8, 5)] + [("n", None), ("z", [0.0] * 3)], "query_id string, vector array<double>")
    told = lambda: sorted(map(tuple, retrieval.candidates(asked, index, 4).select("query_id", "chunk_id", "rank").collect()))
    one = told()
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", 100)
    assert told() == one and len(one) == 4 * 17
