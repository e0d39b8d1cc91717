"""Text rules on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestack.functions import tables
from lodestack.functions import text as T


def told(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_white_space(spark):
    assert told(spark, T.collapsed, " a　b \x1cc ", "", "\n") == ["a b c", "", ""]
    assert told(spark, lambda t: T.tidied(t, F.lit(True)), "1.3协议 目 的", "3.通 用", "1.1 x") == ["1.3 协议目的", "3. 通用", "1.1 x"]
    assert told(spark, lambda t: T.tidied(t, F.lit(False)), "1.3协 议", "a 中 b") == ["1.3协议", "a 中 b"]


def test_fragments(spark):
    assert told(spark, T.is_fragment, "", "x", "…——", "é à", "é à é", "ab", "中文") == [True, True, True, True, False, False, False]


def test_garbled(spark):
    assert told(spark, T.is_garbled, "short english", "a" * 81, "ABC/DEf g", "中 english words", "seven l") == [True, False, True, False, False]


@pytest.mark.parametrize(("before", "text", "copy"), [("全体员工适用本办法", "本办法", True), ("same", "same", True), ("abcdefghij", "bcdefghij", False), ("", "a", False), ("a" * 100, "a" * 50, True), ("a" * 100, "a" * 51, False)])
def test_suffix_copies(spark, before, text, copy):
    assert T.repeats_end(before, text) is copy


def test_contents_and_lists(spark):
    assert told(spark, T.is_contents_line, "第一章......... 12", "第一章 12", "a" * 90 + "..... 3") == [True, False, False]
    assert told(spark, T.is_list_line, "• x", "- x", "-x", "3.14 x", "（2）x", "十一、x", "x") == [True, True, False, True, True, True, False]


def test_watermarks(spark):
    assert told(spark, T.is_watermark, "（注：本文由 AI 生成）", "注: 由ai生成", "本文档可能由 AI 撰写", "本办法") == [False, True, True, False]


def test_tokens_and_codes(spark):
    assert told(spark, T.token_count, "中文 abc, d", "", "a　b") == [4, 0, 2]
    assert told(spark, T.has_protocol_code, "see 0x1F", "0x1", "24-01-01 10", "x0x12") == [True, False, True, False]


def test_table_gate(spark):
    rows = "<tr><td>only latin text here</td></tr>"
    good = "<table><tr><td>名称数量</td></tr><tr><td>甲乙丙丁</td></tr></table>"
    assert told(spark, T.is_poor_table, f"<table>{rows}{rows}</table>", good, "<table></table>", "<table>&nbsp;</table>") == [True, False, True, True]


def test_nfkc_and_entities(spark):
    assert told(spark, T.nfkc, "①（ａ）", None) == ["1(a)", None]
    assert told(spark, T.unescaped, "a&amp;b&lt;", None) == ["a&b<", None]


def test_access_groups(spark):
    df = spark.createDataFrame([(["ops", "x"],), (None,), (["x"],)], "g array<string>")
    assert [r[0] for r in df.select(T.access_groups(F.col("g"))).collect()] == [["ops"], ["rd"], ["rd"]]


def test_rows_of_a_width():
    assert [tables._line(cells, 2) for cells in (["a", "b", "c"], ["a"], ["x|y\n z", "b"])] == ["| a | b |", "| a |  |", "| x\\|y z | b |"]
