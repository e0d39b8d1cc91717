"""Queries over small stated inputs, for rules that the driver's tables hold no input for: tables, titles, items, JSON forms.

What each must give was worked out by hand from the rules and stands as the VALUES of its SQL.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import split, tables
from lodestack.functions import text as T
from lodestack.operators import evaluate, extract, retrieval
from lodestack.operators.chunk import BLOCK, ChunkSettings, attributes, chunk_documents, sections, title_paths
from lodestack.plans.service import CASE, Service, ServiceError
from lodestack.sources import forms, items
from lodestack.sources.shared import own_dir
from lodestack.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return str(x)


def case(columns: str, *rows: tuple):
    """Registers a query under its name with the rows that it must give; ``columns`` are names with DuckDB types."""

    def add(f):
        told = [c.split(" ") for c in columns.split(", ")]
        names = ", ".join(f'"{n}"' for n, _ in told)
        values = ", ".join("(" + ", ".join(f"({_literal(x)})::{t}" for x, (_, t) in zip(r, told, strict=True)) + ")" for r in rows)
        QUERIES[f.__name__] = lambda spark, _: f(spark)
        ORACLE_SQL[f.__name__] = f"SELECT {names} FROM (VALUES {values}) AS told({names})"
        return f

    return add


def _of(spark: SparkSession, values: list, schema: str = "x string") -> DataFrame:
    """A table of ``id``, from 0, and the values."""
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"id int, {schema}")


def _by_row(function: Callable, returns: str, *columns: str) -> Column:
    return F.udf(lambda *row: function(*row), returns)(*columns)


# ---- Text ----


@case("id INT, title VARCHAR, body VARCHAR", (0, "1. 总则", "1.总则"), (1, "2.3 范 A", "2.3范 A"), (2, "12 (1)", "12(1)"), (3, "", ""), (4, "3.1.", "3.1."), (5, "2024 年度报告", "2024年度报告"))
def nfkc_and_titles(spark):
    """Width forms become plain, blanks between CJK characters go, a title has a blank after its number."""
    df = _of(spark, ["１.总　则", " 2.3范 A ", "１２(1)", "　\x1c ", "3.1.", "2024年 度 报告"]).withColumn("x", T.nfkc(F.col("x")))
    tidied = lambda title: T.tidied(F.col("x"), F.lit(title))
    return df.select("id", tidied(True).alias("title"), tidied(False).alias("body"))


@case("id INT, poor BOOLEAN", (0, True), (1, True), (2, False), (3, True), (4, False), (5, True), (6, False))
def table_gate(spark):
    """Empty, or rows of Latin text with hardly any CJK."""
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    latin = "abcdefghij"
    values = ["<table><tr><td>&nbsp;</td></tr></table>", row(latin, latin) + row("中"), row(latin, latin), row(latin) + row("abcde") + row("1"), row(latin, latin) + row("中文字符"), "", row(latin[:7]) * 2]
    return _of(spark, values).select("id", T.is_poor_table(F.col("x")).alias("poor"))


@case("id INT, plain VARCHAR", (0, "a b & c"), (1, ""), (2, "x < y"))
def tags_stripped(spark):
    """Tags become blanks; entities are resolved apart from that."""
    return _of(spark, ["<p>a<br/>b</p> &amp; c", "<td>", "x &lt; y"]).select("id", T.unescaped(T.tags_stripped(F.col("x"))).alias("plain"))


@case("id INT, told VARCHAR", (0, "rd"), (1, "ops"), (2, "ops,after_sales"), (3, "rd"), (4, "rd"))
def access_groups(spark):
    df = _of(spark, [(None,), ([" ops "],), (["ops", "x", "after_sales"],), (["x"],), ([],)], "x array<string>")
    return df.select("id", F.array_join(T.access_groups(F.col("x")), ",").alias("told"))


@case("id INT, told VARCHAR", (0, "2024-02-29T23:59:58"), (1, None))
def iso_seconds(spark):
    return _of(spark, ["2024-02-29 23:59:58.999", None]).select("id", T.iso_seconds(F.col("x").cast("timestamp")).alias("told"))


@case("id INT, told VARCHAR", (0, "a b  c"), (1, ""))
def embedding_input(spark):
    return _of(spark, ["a\nb\n\nc", ""]).select("id", T.for_embedding(F.col("x")).alias("told"))


# ---- Tables ----

HEAD = "<table><caption>表1</caption><thead><tr><th>名</th><th>值</th></tr><tr><th>again</th></tr></thead><tbody><tr><td>甲|乙</td><td>1</td><td>cut</td></tr><tr><td>丙 \n 丁</td></tr></tbody></table>"
PLAIN = "<table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>b<table><tr><td>in</td></tr></table></td></tr><tr><td>lost<td>kept</td></tr></table>"
CELLS = "<table><tr><td>k</td><td>v</td></tr><tr><td>{}</td><td>2</td></tr></table>"


@case("id INT, caption VARCHAR, headers VARCHAR, body VARCHAR, cols INT",
      (0, "表1", "名,值", "甲|乙,1,cut;丙 \n 丁", 2), (1, "", "k,v", "a,bin;kept", 2), (2, "c", "", "", None), (3, "", "x", "", 1))
def table_parse(spark):
    """The first head row is the header; inner tables are text; an unclosed cell is lost."""

    def told(html):
        t = tables.parse(html)
        return t.caption, ",".join(t.headers), ";".join(",".join(r) for r in t.rows), tables.width(t)

    df = _of(spark, [HEAD, PLAIN, "<table><caption>c</caption></table>", "<table><tr><td>x</td></tr></table>"])
    return df.select("id", _by_row(told, "caption string, headers string, body string, cols int", "x").alias("t")).select("id", "t.*")


@case("id INT, at INT, text VARCHAR, kind VARCHAR, row_start INT, row_end INT, cols INT",
      (0, 0, "标题\n\n表1\n\n| 名 | 值 |\n| --- | --- |\n| 甲\\|乙 | 1 |\n| 丙 丁 |  |", "table_rows", 0, 1, 2),
      (1, 0, "P\n\n| k | v |\n| --- | --- |\n| a | bin |", "table_rows", 0, 0, 2), (1, 1, "| k | v |\n| --- | --- |\n| kept |  |", "table_rows", 1, 1, 2),
      (2, 0, "c", "table_fallback", None, None, None), (3, 0, "| x |\n| --- |", "table_rows", 0, -1, 1), (4, 0, "（空表）", "table_fallback", None, None, None))
def table_row_groups(spark):
    """Rows are packed under header and caption; a row that is too long stands alone; the prefix goes to the first group."""
    values = [(HEAD, "标题", 500), (PLAIN, "P", 40), ("<table><caption>c</caption></table>", None, 50), ("<table><tr><td>x</td></tr></table>", "", 50), ("<table></table>", None, 50), ("  ", "p", 50)]
    df = _of(spark, values, "html string, prefix string, size int")
    parts = [df.where(F.col("size") == s).select("id", F.posexplode(tables.tables_split(F.col("html"), F.col("prefix"), s)).alias("at", "p")) for s in (500, 40, 50)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "at", "p.*")


@case("id INT, html VARCHAR",
      (0, "<table class='a'><caption>x &lt; y</caption><tr></tr></table>"), (1, "<table><caption>t</caption><tbody><tr><td>a &amp; b</td></tr></tbody></table>"),
      (2, "<table><caption>own</caption></table>"), (3, "<table></table>"), (4, ""))
def table_captions(spark):
    values = [("<table class='a'><tr></tr></table> ", [" x ", "", "< y"]), ("a & b", ["t"]), ("<table><caption>own</caption></table>", ["t"]), ("<table></table>", [" "]), ("", ["t"])]
    return _of(spark, values, "body string, captions array<string>").select("id", _by_row(tables.captioned, "string", "body", "captions").alias("html"))


@case("id INT, html VARCHAR",
      (0, '<table data-logical-id="t7" class=x><tr></tr></table>'), (1, '<table data-logical-id="own"></table>'),
      (2, '<table data-logical-id="t7"><tbody><tr><td>a &lt; b</td></tr></tbody></table>'), (3, '<table data-logical-id="t7">a<table></table>'))
def table_ids(spark):
    """The first table gets the id unless it has one; an inner table's end is taken for its own."""
    values = ["x<TABLE class=x><tr></tr></table>y".replace("TABLE", "table"), '<table data-logical-id="own"></table>', "a < b", "<table>a<table></table></table>"]
    return _of(spark, values).select("id", _by_row(lambda h: tables.with_id(h, "t7"), "string", "x").alias("html"))


@case("id INT, told VARCHAR", (0, "名,值,again"), (1, "k,v"), (2, "k,v"), (3, ""), (4, "a & b"))
def table_signatures(spark):
    values = [HEAD, PLAIN, CELLS.format(1), "no table", "<table><tr><th> </th><th>a &amp; <b>b</b></th></tr></table>"]
    return _of(spark, values).select("id", _by_row(lambda h: ",".join(tables.Markup(h).signature()), "string", "x").alias("told"))


@case("id INT, goes_on BOOLEAN, html VARCHAR",
      (0, True, '<table data-logical-id="a" data-page-span="1-3" data-continued="true"><tbody><tr><td>k</td><td>v</td></tr><tr><td>1</td><td>2</td></tr><tr><td>k</td><td>v</td></tr><tr><td>3</td><td>2</td></tr></tbody></table>'),
      (1, True, '<table data-logical-id="" data-page-span="" data-continued="true"><tbody><tr><td>1</td></tr><tr><td>续表</td></tr></tbody></table>'),
      (2, False, '<table data-logical-id="" data-page-span="" data-continued="true"><tbody><tr><td>1</td></tr><tr><td>2</td></tr></tbody></table>'),
      (3, False, "<table></table>\nx"))
def table_continuation(spark):
    """A marker in the second or equal headers tell; a header row of ``th`` outside a head is lost, one of ``td`` stays a row."""
    one = lambda cell, rest: f"<table><tr><th>{cell}</th></tr><tr><td>{rest}</td></tr></table>"
    spanned = lambda i, span, v: CELLS.format(v).replace("<table>", f'<table data-logical-id="{i}" data-page-span="{span}">')
    values = [(spanned("a", "1-2", 1), spanned("b", "3-3", 3)), (one("x", 1), one("y", "续表")), (one("x", 1), one("y", 2)), ("<table></table>", "x")]
    df = _of(spark, values, "a string, b string")
    return df.select("id", _by_row(tables.goes_on, "boolean", "a", "b").alias("goes_on"), _by_row(tables.joined, "string", "a", "b").alias("html"))


# ---- Splitting ----


@case("id INT, at INT, piece VARCHAR",
      (0, 0, "short"), (2, 0, "aaaa\n\nbbbb"), (2, 1, "cccc"), (3, 0, "A. B.".replace(" ", "")), (3, 1, "C."), (4, 0, "aa，bb，"), (4, 1, "cc，dd"), (5, 0, "x" * 30), (5, 1, "x" * 30 + "y" * 4), (6, 0, "keep whole text"))
def recursive_split_levels(spark):
    """Paragraphs, then sentences, then soft units, then windows; joining sentences drops their blank; a short tail is glued on."""
    values = [("short", 10), ("  ", 10), ("aaaa\n\nbbbb\n\n\n cccc", 10), ("A. B. C.", 5), ("aa，bb，cc，dd", 6), ("x" * 60 + "y" * 4, 30), ("keep whole text", 0)]
    df = _of(spark, values, "x string, size int")
    return df.select("id", F.posexplode(_by_row(lambda t, n: split.recursive_split(t, n), "array<string>", "x", "size")).alias("at", "piece"))


@case("id INT, at INT, piece VARCHAR, cut BOOLEAN",
      (0, 0, "H", False), (1, 0, "H\n\n短正文", False), (2, 0, "H\n\n" + "一" * 37 + "。", True), (2, 1, "H\n\n" + "二" * 37 + "。", True), (3, 0, "甲" * 29 + "。", True), (3, 1, "乙" * 29 + "。", True), (4, 0, "ab\ncd", True))
def section_split_cases(spark):
    """A header alone, a whole section, parts that each have the header, a body without header, and short parts put together."""
    values = [("H", " ", 30, 5), ("H", "短正文", 30, 5), ("H", "一" * 37 + "。" + "二" * 37 + "。", 30, 5), (None, "甲" * 29 + "。" + "乙" * 29 + "。", 30, 5), ("", "ab\n\ncd", 3, 3)]
    told = lambda h, b, size, least: split.section_pieces(h, b, size, 0, least, 50)
    df = _of(spark, values, "header string, body string, size int, least int")
    df = df.select("id", _by_row(told, "struct<pieces:array<string>,cut:boolean>", "header", "body", "size", "least").alias("t"))
    return df.select("id", F.posexplode("t.pieces").alias("at", "piece"), "t.cut")


@case("id INT, told VARCHAR", (0, "abcdefgh|ijkl"), (1, "abcd|xyz"), (2, "abcabc"), (3, "ab"))
def overlap_dedupe(spark):
    """A part loses the beginning that repeats the end of the part before; one that is gone then isn't there."""
    values = [(["abcdefgh", "fghijkl"], 3), (["abcd", "cdxyz"], 2), (["abcabc", "abc"], 3), (["ab"], 2)]
    # The longest repeat that is looked for is a third of the part, or the least length if that is more.
    return _of(spark, values, "x array<string>, least int").select("id", F.array_join(_by_row(split.without_overlaps, "array<string>", "x", "least"), "|").alias("told"))


# ---- Titles, sections and chunks ----


@case("id INT, at INT, path VARCHAR",
      (0, 0, "文档"), (0, 1, "文档 > 1 总则"), (0, 2, "文档 > 1 总则 > 1.1 范围"), (0, 3, "文档 > 2 定义"), (0, 4, "文档 > 2 定义 > 附录"),
      (1, 0, "1.2 a"), (1, 1, "1.2 a > 1.2.1 b"), (1, 2, "2024年度"), (2, 0, "x"), (2, 1, "x > y"), (2, 2, "x > z"))
def title_stack(spark):
    """Numbers tell a level, the first title without one is at the top, others have the given level or the depth."""
    values = [([("文档", 1), ("1 总则", 1), ("1.1 范围", 1), ("2 定义", 1), ("附录", None)],), ([("1.2 a", 1), ("1.2.1 b", None), ("2024年度", 3)],), ([("x", 2), ("y", 1), ("z", 0)],)]
    df = _of(spark, values, "t array<struct<title:string,level:int>>")
    return df.select("id", F.posexplode(title_paths(F.col("t"))).alias("at", "p")).select("id", "at", F.array_join("p", " > ").alias("path"))


SPANNED = '<table data-page-span="3-{}"><thead><tr><th>k</th></tr></thead><tbody><tr><td>v</td></tr></tbody></table>'
BLOCKS = [
    ("d", 0, "paragraph", "前言内容在此，不属于任何标题之下。", None, None, 0, [1.0, 2.0, 3.0, 4.0], None), ("d", 1, "title", "1 总则", None, None, 0, None, 1), ("d", 2, "title", "1.1 范围", None, None, 1, None, 1),
    ("d", 3, "list_item", "本办法适用于全体员工与各部门。", None, None, 1, None, None), ("d", 4, "title", "1.2 表格", None, None, 2, None, 1), ("d", 5, "table", None, SPANNED.format(5), "tbl-000", 2, None, None),
    ("d", 6, "paragraph", "表格之后的正文内容没有标题前缀。", None, None, None, None, None), ("d", 7, "paragraph", " ", None, None, 9, None, None),
]


@case("section INT, header VARCHAR, body VARCHAR, prefix VARCHAR, path VARCHAR, page_num INT, page_end INT",
      (1, None, "前言内容在此，不属于任何标题之下。", None, "", 1, 1), (2, "1 总则\n\n1.1 范围", "本办法适用于全体员工与各部门。", None, "1 总则 > 1.1 范围", 1, 2),
      (3, "1.2 表格", "", None, "1 总则 > 1.2 表格", 3, 3), (4, None, None, "1.2 表格", "1 总则 > 1.2 表格", 4, 6), (5, None, "表格之后的正文内容没有标题前缀。", None, "1 总则 > 1.2 表格", None, None))
def section_walk(spark):
    """Runs of titles head what follows them; titles right before a table are its prefix; a table's own page span counts."""
    told = sections(spark.createDataFrame(BLOCKS, BLOCK))
    return told.select(F.col("section").cast("int").alias("section"), "header", "body", "prefix", F.array_join("path", " > ").alias("path"), "page_num", "page_end")


@case("doc_id VARCHAR, chunk_index INT, text VARCHAR, kind VARCHAR, section_title VARCHAR, parent VARCHAR, crosses BOOLEAN, boxed BOOLEAN, next_index INT, told VARCHAR",
      ("d", 0, "前言内容在此，不属于任何标题之下。", "paragraph", None, None, False, True, 1, "c,7,ops,2024-01-01T00:00:00,a.pdf"),
      ("d", 1, "1 总则\n\n1.1 范围\n\n本办法适用于全体员工与各部门。", "paragraph", "1.1 范围", "1 总则", True, False, 2, "c,7,ops,2024-01-01T00:00:00,a.pdf"),
      ("d", 2, "1.2 表格\n\n| k |\n| --- |\n| v |", "table_rows", "1.2 表格", "1 总则", True, False, 3, "c,7,ops,2024-01-01T00:00:00,a.pdf"),
      ("d", 3, "表格之后的正文内容没有标题前缀。", "paragraph", "1.2 表格", "1 总则", False, False, None, "c,7,ops,2024-01-01T00:00:00,a.pdf"),
      ("f", 0, "只有全文而没有块的文档内容。", "full_text_fallback", None, None, False, False, None, "rd"))
def chunk_cases(spark):
    """Chunks with their places and what they take over from their document; a document without blocks is cut from its full text."""
    docs = [("d", "x", '{"category": "c", "doc_version": " 7 ", "access_group": "ops", "create_time": "2024-01-01T00:00:00"}', "a.pdf"), ("f", "只有全文而没有块的文档内容。", None, " ")]
    docs = spark.createDataFrame(docs, "doc_id string, full_text string, metadata string, file_path string")
    told = chunk_documents(docs, spark.createDataFrame(BLOCKS, BLOCK), ChunkSettings())
    return told.select(
        "doc_id", "chunk_index", F.col("chunk_text").alias("text"), F.col("chunk_kind").alias("kind"), "section_title", F.col("parent_section").alias("parent"), F.col("is_cross_page").alias("crosses"), F.col("bbox").isNotNull().alias("boxed"),
        F.col("next_chunk_index").alias("next_index"), F.concat_ws(",", "category", "doc_version", F.array_join("access_group", "+"), "create_time", "file_path").alias("told"),
    )


@case("doc_id VARCHAR, source VARCHAR, doc_version VARCHAR, groups VARCHAR, create_time VARCHAR, update_time VARCHAR",
      ("a", "s", "1.5", "ops,rd", "t", "2024-01-02T03:04:05"), ("b", None, None, "rd", "2024-01-01T00:00:00", "2024-01-02T03:04:05"), ("c", None, None, "rd", "2024-01-01T00:00:00", "u"))
def document_attributes(spark):
    rows = [("a", '{"source": "s", "doc_version": 1.5, "access_group": ["ops", "x", "rd"], "create_time": "t"}'), ("b", '{"source": " ", "access_group": "x"}'), ("c", '{"update_time": "u", "create_time": ""}')]
    docs = spark.createDataFrame(rows, "doc_id string, metadata string").withColumns({"created_at": F.lit("2024-01-01 00:00:00").cast("timestamp"), "updated_at": F.lit("2024-01-02 03:04:05").cast("timestamp")})
    return attributes(docs).select("doc_id", "source", "doc_version", F.array_join("access_group", ",").alias("groups"), "create_time", "update_time")


# ---- Items, extraction and JSON forms ----

TABLE = "<table><thead><tr><th>名称</th><th>数量</th></tr></thead><tbody><tr><td>{}</td><td>一</td></tr></tbody></table>"
FLAT = [
    {"type": "text", "text": "1.总 则", "text_level": "1", "page_idx": 0}, {"type": "text", "text": "本办法适用于全体员工。", "page_idx": 0, "bbox": [0, 0, 1, 1]}, {"type": "text", "text": "全体员工。", "page_idx": 0},
    {"type": "text", "text": "页脚文字"}, {"type": "list", "list_items": ["第一项内容说明", " ", {"text": "第二项内容说明"}, {"content": "第三项内容说明"}], "page_idx": 1}, {"type": "list", "list_items": [" "], "text": "不用的文字"},
    {"type": "table", "table_body": TABLE.format("甲"), "table_caption": "表1", "page_idx": 1}, {"type": "table", "table_body": TABLE.format("乙"), "page_idx": 2, "bbox": [1, 2, 3]}, {"type": "image"}, "junk",
    {"type": "text", "text": "short english line here", "page_idx": -1}, {"type": "text", "text": "页脚文字"}, {"type": "text", "text": "（1）条目内容在此处说明", "text_level": "x"}, {"type": "text", "text": "目录..........12"}, {"type": "title", "text": "二 附则说明", "text_level": 0},
]
PAGED = [
    [{"type": "title", "content": {"title_content": [{"content": "标题一"}], "level": 0}}, {"type": "paragraph", "content": {"paragraph_content": [{"content": "正文", "children": [{"content": "不用"}]}, {"children": [{"children": [{"content": "很深的内容。"}]}]}]}}],
    "junk", [{"type": "index", "content": {"list_items": [[{"content": "甲方条款说明"}], " "]}}, {"type": "image"}, {"type": "table", "content": {"html": TABLE.format("丙"), "captions": "表二"}, "bbox": [1, 2, 3, 4]}],
]


def _items(spark: SparkSession) -> DataFrame:
    told = [("f", json.dumps(FLAT, ensure_ascii=False)), ("p", json.dumps(PAGED, ensure_ascii=False)), ("e", "[]"), ("n", "{}")]
    return items.items_of(spark.createDataFrame(told, "doc_id string, json string"))


@case("doc_id VARCHAR, at INT, type VARCHAR, text VARCHAR, text_level VARCHAR, list_items VARCHAR, page_idx VARCHAR",
      ("p", 0, "text", "标题一", "1", None, "0"), ("p", 1, "text", "正文很深的内容。", "0", None, "0"), ("p", 2, "list", None, None, "甲方条款说明", "2"), ("p", 3, "table", None, None, None, "2"))
def paged_items(spark):
    """Items by page as flat ones: a string as content goes before children, spans are read to the end."""
    place = F.expr("row_number() over (partition by doc_id order by pos) - 1").cast("int").alias("at")
    return _items(spark).where("doc_id = 'p'").select("doc_id", place, "type", "text", "text_level", F.array_join("list_items", "|").alias("list_items"), "page_idx")


@case("doc_id VARCHAR, at INT, type VARCHAR, text VARCHAR, table_id VARCHAR, page_idx INT, merged INT",
      ("f", 0, "title", "1. 总则", None, 0, 0), ("f", 1, "paragraph", "本办法适用于全体员工。", None, 0, 0), ("f", 2, "list_item", "第一项内容说明", None, 1, 0), ("f", 3, "list_item", "第二项内容说明", None, 1, 0),
      ("f", 4, "list_item", "第三项内容说明", None, 1, 0), ("f", 5, "table", None, "tbl-000", 1, 1), ("f", 6, "list_item", "(1)条目内容在此处说明", None, None, 0), ("f", 7, "title", "二附则说明", None, None, 0),
      ("p", 0, "title", "标题一", None, 0, 0), ("p", 1, "paragraph", "正文很深的内容。", None, 0, 0), ("p", 2, "list_item", "甲方条款说明", None, 2, 0), ("p", 3, "table", None, "tbl-000", 2, 0))
def extract_blocks_cases(spark):
    """Suffix copies, repeated short lines, Latin lines and contents lines go; tables that go on are one."""
    return extract.extract(_items(spark))[1].select("doc_id", F.col("order").cast("int").alias("at"), "type", "text", F.col("logical_table_id").alias("table_id"), "page_idx", F.col("n_merged").cast("int").alias("merged"))


@case("doc_id VARCHAR, pages INT, other INT, elements INT, fragments INT, garbled INT, titles INT, paragraphs INT, list_items INT, tables INT, merged INT",
      ("f", 3, 2, 7, 1, 1, 2, 1, 4, 1, 1), ("p", 3, 0, 0, 0, 0, 1, 1, 1, 1, 0))
def extract_report_cases(spark):
    """An item without content and a list of blanks are other; fragments and garbled lines are elements too."""
    told = extract.extract(_items(spark))[0]
    counts = {"page_count": "pages", "discarded_other": "other", "dropped_elements": "elements", "dropped_fragments": "fragments", "dropped_garbled": "garbled", "title_count": "titles", "paragraph_count": "paragraphs", "list_item_count": "list_items", "table_count": "tables", "table_merged_count": "merged"}
    return told.select("doc_id", *(F.col(c).cast("int").alias(n) for c, n in counts.items()))


@case("id INT, dropped VARCHAR", (0, None), (1, "fragment"), (2, "fragment"), (3, None), (4, None), (5, None), (6, None), (7, "fragment"))
def suffix_copy_cases(spark):
    """A text that ends the last one kept goes if it is a leftover; a table begins anew."""
    rows = [("paragraph", "本办法适用于公司全体正式员工。"), ("paragraph", "正式员工。"), ("paragraph", "本办法适用于公司全体正式员工。"), ("paragraph", "其他说明"), ("table", "<table></table>"), ("paragraph", "说明"), ("paragraph", "附加说明"), ("paragraph", "说明")]
    nodes = spark.createDataFrame([("d", i, 0, *r, None) for i, r in enumerate(rows)], "doc_id string, pos long, sub int, type string, text string, dropped string")
    return extract._without_suffix_copies(nodes).select(F.col("pos").cast("int").alias("id"), "dropped")


@case("id INT, at INT, type VARCHAR, told VARCHAR, page_idx INT, boxed BOOLEAN, level INT",
      (0, 0, "table", "h", None, False, None), (0, 1, "title", "t", 3, True, 2), (0, 2, "paragraph", "p", 4, False, None))
def blocks_from_json(spark):
    """Unknown types and entries that aren't objects are dropped, numbers may be written as text, boxes need four numbers."""
    told = [{"type": "title", "order": 5, "text": "t", "page_idx": "3", "bbox": [1, 2, 3, 4], "text_level": 2}, {"type": "image"}, 7, {"type": " table ", "html": "h", "bbox": [1, 2], "page_idx": "x"}, {"type": "paragraph", "order": 9, "text": "p", "page_idx": 4.7, "bbox": "no"}]
    df = _of(spark, [json.dumps(told), '{"a": 1}', None, "broken["])
    return df.select("id", F.posexplode(forms.blocks_of_json(F.col("x"))).alias("at", "b")).select("id", "at", "b.type", F.coalesce("b.text", "b.html").alias("told"), "b.page_idx", F.col("b.bbox").isNotNull().alias("boxed"), F.col("b.text_level").alias("level"))


@case("id INT, told VARCHAR", (0, '[{"type":"title","order":0,"text":"标题","page_idx":1},{"type":"table","order":1,"html":"<table>","bbox":[1.0,2.0,3.0,4.5]}]'), (1, "[]"))
def blocks_to_json(spark):
    rows = [([("title", 0, "标题", None, None, 1, None, None), ("table", 1, None, "<table>", None, None, [1.0, 2.0, 3.0, 4.5], None)],), (None,)]
    return _of(spark, rows, f"b {forms.BLOCK_JSON}").select("id", forms.blocks_json(F.col("b")).alias("told"))


@case("id INT, paragraphs INT, former INT, tables INT, titles INT", (0, 4, 4, 2, 0), (1, 5, 6, 0, 0), (2, None, None, None, None), (3, None, None, None, None))
def report_from_json(spark):
    """A former name stands in for a missing count; what isn't an object has no report."""
    df = _of(spark, ['{"paragraph_block_count": 4, "table_count": "2"}', '{"paragraph_count": 5, "paragraph_block_count": 6}', "[1]", None])
    r = forms.report_of_json(F.col("x"))
    return df.select("id", r["paragraph_count"].alias("paragraphs"), r["paragraph_block_count"].alias("former"), r["table_count"].alias("tables"), r["title_count"].alias("titles"))


@case("id INT, told VARCHAR, n INT, elements INT", (0, '{"a": "é"}', 1, 3), (1, None, 0, 0))
def stored_documents(spark):
    """Stored text read back: metadata that isn't an object is null, a missing report counts nothing."""
    df = _of(spark, [('[{"type": "title"}]', '{"element_count": 3}', '{"a": "é"}'), (None, None, "[1]")], "blocks string, extract_report string, metadata string")
    return forms.extracted_of(df).select("id", F.col("metadata").alias("told"), F.size("blocks").alias("n"), F.col("extract_report.element_count").alias("elements"))


@case("doc_id VARCHAR, pages INT", ("f", 3), ("p", 3))
def page_counts(spark):
    """One more than the highest page; pages that are negative don't count."""
    return extract.page_counts(_items(spark)).select("doc_id", F.col("page_count").cast("int").alias("pages"))


@case("doc_id VARCHAR", ("x",))
def empty_extractions(spark):
    """Documents of which nothing is left."""
    rows = [("x", [{"type": "text", "text": "short english line"}, {"type": "image"}]), ("y", [{"type": "text", "text": "留下的正文内容。"}])]
    told = spark.createDataFrame([(d, json.dumps(v)) for d, v in rows], "doc_id string, json string")
    return extract.empty_documents(extract.extract(items.items_of(told))[0])


@case("id INT, at INT, piece VARCHAR",
      (0, 0, "一" * 24 + "。"), (0, 1, "。" + "二" * 29), (0, 2, "二" * 21), (1, 0, "三" * 24 + "，"), (1, 1, "三" * 20), (2, 0, "四" * 30), (2, 1, "四" * 22), (3, 0, "五" * 30 + "五" * 10))
def window_cuts(spark):
    """A strong mark in the second half ends a window, else a weak one, else its length; windows overlap, a short tail is glued on."""
    values = [("一" * 24 + "。" + "二" * 49, 30, 1), ("三" * 24 + "，" + "三" * 20, 30, 0), ("四" * 52, 30, 0), ("五" * 40, 30, 0)]
    df = _of(spark, values, "x string, size int, overlap int")
    return df.select("id", F.posexplode(_by_row(split.windows, "array<string>", "x", "size", "overlap")).alias("at", "piece"))


# ---- Retrieval, evaluation and the service ----

CHUNKS = [("1", "d1", 0, "alpha beta gamma", "law", ["rd"], '{"level": 2}', "AB"), ("2", "d1", 1, "alpha delta", "law", ["rd", "ops"], None, "CD"), ("3", "d2", 0, "omega psi", None, ["rd"], '{"level": true, "x": null}', "EF")]


def _chunks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, chunk_index int, chunk_text string, category string, access_group array<string>, metadata string, content_hash string")


@case("filters VARCHAR, found VARCHAR", ("{}", "1,2,3"), ('{"category": "law"}', "1,2"), ('{"category": null}', "3"), ('{"level": 2.0}', "1"), ('{"level": 1}', "3"), ('{"x": null}', "1,2,3"),
      ('{"access_group": ["rd"]}', "1,3"), ('{"access_group": ["rd"], "doc_id": "d1"}', "1"), ('{"absent": 0}', None), ('{"chunk_index": 0, "level": true}', "3"))
def filter_cases(spark):
    """All names must fit: columns first, then metadata; a missing one equals null, numbers equal truth values, lists a whole list."""
    asked = [json.dumps(f) for f in ({}, {"category": "law"}, {"category": None}, {"level": 2.0}, {"level": 1}, {"x": None}, {"access_group": ["rd"]}, {"access_group": ["rd"], "doc_id": "d1"}, {"absent": 0}, {"chunk_index": 0, "level": True})]
    df, chunks = spark.createDataFrame([(a,) for a in asked], "filters string"), _chunks(spark)
    fit = F.when(retrieval.fits(retrieval.filters_of(F.col("filters")), retrieval.values_of(chunks.columns)), F.col("chunk_id"))
    found = chunks.join(F.broadcast(df)).groupBy("filters").agg(F.array_join(F.array_sort(F.collect_list(fit)), ",").alias("found"))
    return found.select("filters", F.nullif("found", F.lit("")).alias("found"))


@case("case_id VARCHAR, ids VARCHAR", ("both", "1"), ("doc", "2"), ("hash", "3"), ("order", "3,1,2"))
def evidence_cases(spark):
    """A key's document, if named, and its hash in any case or its anchor must fit; keys come in order, then documents and places."""
    keys = [("both", 0, " beta ", "d1", "ef"), ("doc", 0, "delta", "d1", None), ("doc", 1, "delta", "d2", None), ("hash", 0, None, None, " eF "), ("order", 0, "psi", None, None), ("order", 1, "alpha", None, None), ("order", 2, "psi", None, None)]
    keys = spark.createDataFrame(keys, "case_id string, key_pos int, anchor_text string, doc_id string, content_hash string")
    return evaluate.resolved_ids(evaluate.evidence_pairs(keys, _chunks(spark))).select("case_id", F.array_join("resolved", ",").alias("ids"))


@case("case_id VARCHAR, hit INT, recall DOUBLE, mrr DOUBLE",
      ("ids", 1, 0.5, 0.5), ("words", 1, 0.0, 1.0), ("all", 0, 0.0, 0.0), ("either", 1, 0.0, 1.0), ("negative", 1, 0.0, 0.0), ("shown", 0, 0.0, 0.0), ("nothing", 0, 0.0, 0.0), ("vacuous", 1, 0.0, 0.0))
def score_cases(spark):
    """Ids or words make a row relevant; a negative case hits if none is, and has neither recall nor rank."""
    rows = [("ids", ["3", "9"], None, "any", True), ("words", None, ["ALPHA"], "any", True), ("all", None, ["alpha", "zeta"], "all", True), ("either", ["9"], ["beta", "zeta"], "any", True),
            ("negative", ["9"], None, "any", False), ("shown", ["1"], None, "any", False), ("nothing", ["1"], None, "any", True), ("vacuous", None, None, "any", False)]
    cases = spark.createDataFrame(rows, "case_id string, relevant_chunk_ids array<string>, expected_keywords array<string>, keyword_match_mode string, expect_hit boolean")
    found = [(c[0], rank, i, CHUNKS[int(i) - 1][3]) for c in rows if c[0] != "nothing" for rank, i in ((1, "1"), (2, "3"))]
    return evaluate.score_cases(cases, spark.createDataFrame(found, "case_id string, rank int, chunk_id string, chunk_text string")).drop("n_retrieved")


def _service(spark: SparkSession) -> Service:
    service = Service(spark, Store(spark, f"{own_dir(spark)}/service-{uuid.uuid4().hex}"), min_score=0.0)
    service.store.replace("chunks", _chunks(spark).drop("content_hash"), "doc_id")
    return service


@case("case_id VARCHAR, hit INT, recall DOUBLE, mrr DOUBLE, ids VARCHAR, size INT, top_k INT", ("a", 1, 1.0, 1.0, "1", 3, 2), ("b", 0, 0.0, 0.0, "3", 3, 2), ("c", 1, 0.0, 0.0, "3", 3, 2))
def service_eval(spark):
    """A run over three cases with their filters, joined to its items: evidence, words, and a negative case."""
    service = _service(spark)
    service.build_index([])
    rows = [("a", "alpha beta gamma", None, None, [("beta", None, None)], "any", 1, True, True, '{"level": 2}'), ("b", "omega", None, ["alpha"], None, "any", 2, True, True, '{"doc_id": "d2"}'),
            ("c", "omega", None, ["alpha"], None, None, 2, True, False, '{"doc_id": "d2"}'), ("off", "x", ["1"], None, None, "any", None, False, True, None)]
    service.upsert_cases(spark.createDataFrame(rows, CASE).withColumn("at", F.lit(0)), "at")
    run = service.run_eval()
    told = run.join(service.run_items(run.first()["run_id"]).drop("latency_ms"), "run_id")
    return told.select("case_id", "hit", "recall", "mrr", F.array_join("retrieved_chunk_ids", ",").alias("ids"), F.col("dataset_size").cast("int").alias("size"), "top_k")


@case("query_text VARCHAR, top_k INT, before_filter INT, after_filter INT, filters_applied BOOLEAN, is_empty_recall BOOLEAN, error_code VARCHAR",
      ("alpha", 3, 0, 0, False, True, "INDEX_NOT_READY"), ("alpha", 1, 3, 1, True, False, None), ("alpha", 2, 3, 0, True, True, None))
def service_log(spark):
    """A query before the index is built, one that finds a row, and one whose filter leaves none."""
    service, asked = _service(spark), spark.createDataFrame([("q", "alpha")], "query_id string, query_text string")
    try:
        service.query(asked)
    except ServiceError:
        service.build_index()
    service.query(asked, 1, {"category": "law"})
    service.query(asked, 2, {"category": "none"})
    count = lambda c: F.col(f"retrieved_{c}").cast("int").alias(c)
    return service.store.read("query_logs").select("query_text", "top_k", count("before_filter"), count("after_filter"), "filters_applied", "is_empty_recall", "error_code")


@case("freeze_label VARCHAR, docs INT, chunks INT, version VARCHAR, doc_id VARCHAR, chunk_index INT, preview VARCHAR",
      ("all", 2, 3, None, "d1", 0, "alpha beta gamma"), ("all", 2, 3, None, "d1", 1, "alpha delta"), ("all", 2, 3, None, "d2", 0, "omega psi"), ("one", 1, 1, "v2", "d2", 0, "omega psi"))
def service_freezes(spark):
    """Heads of snapshots joined to their first items."""
    service = _service(spark)
    told = [service.freeze_detail(service.freeze(*a)) for a in (("all",), (" one ", ["d2"], None, "v2"))]
    parts = [head.join(rows, "freeze_id").select("freeze_label", F.col("doc_count").cast("int").alias("docs"), F.col("chunk_count").cast("int").alias("chunks"), F.col("pipeline_version").alias("version"), "doc_id", "chunk_index", "preview") for head, rows in told]
    return parts[0].unionByName(parts[1])


@case("extracted_documents INT, chunked_documents INT, chunks INT, index_ready BOOLEAN", (0, 2, 3, True))
def service_health(spark):
    service = _service(spark)
    service.build_index()
    return service.health().select(*(F.col(c).cast("int").alias(c) for c in ("extracted_documents", "chunked_documents", "chunks")), "index_ready")
