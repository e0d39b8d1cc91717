"""Text rules as column expressions. Patterns carry (?U), so that classes mean Unicode as the rules do."""

from __future__ import annotations

import html
import unicodedata
from functools import partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.batches import sliced

# Character ranges, patterns and bounds of the text rules.
CJK = "一-鿿㐀-䶿豈-﫿"
SPACES = r"(?U)[\s\x1C-\x1F]+"
SYMBOLS_ONLY = r"(?U)^[\W_]+$"
DOTTED_LINE = r"(?U)^.{0,40}[\.·…\s]{3,}.{0,20}\d+\s*$"
TITLE_NUMBER = r"(?U)^(\d+(?:\.\d+)*\.?)(?=[^\s\d.])"
LEADING_NUMBER = r"(?U)^(\d+(?:\.\d+)*)"
LIST_LINE = r"(?U)^(?:[•·●○◆▪►➤]\s*|[-–—]\s+|\d+[\.、．]\s*|[（(]\d+[）)]\s*|[一二三四五六七八九十]+[、．.]\s*)"
WATERMARKS = [r"^\(?\s*注\s*[:：].*AI\s*生成", r"文档部分内容可能由\s*AI\s*生成", r"本(?:文档|内容).{0,20}由\s*AI\s*(?:生成|撰写)"]
PROTOCOL_CODE = r"(?U)\b0x[0-9A-Fa-f]{2,}\b"
PROTOCOL_RUN = r"(?U)(?:[0-9A-Fa-f]{2}[\s\-:]){3,}[0-9A-Fa-f]{2}"
SHORT_REPEATED, TOC_BELOW, GARBLED_UPTO = 30, 80, 80
ACCESS_GROUPS = ["rd", "ops", "after_sales"]


def _by_text(function, text: Column) -> Column:
    @F.arrow_udf("string")
    def each(texts: pa.Array) -> pa.Array:
        return sliced(lambda t: None if t is None else function(t), pa.string(), texts)

    return each(text)


def nfkc(text: Column) -> Column:
    """Unicode NFKC form; Spark has no function for it."""
    return _by_text(partial(unicodedata.normalize, "NFKC"), text)


def unescaped(text: Column) -> Column:
    """HTML entities resolved."""
    return _by_text(html.unescape, text)


def stripped(text: Column) -> Column:
    """White space, in the Unicode sense, off both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def tidied(text: Column, is_title: Column) -> Column:
    """Collapsed, without blanks between two CJK characters; titles have a blank after their number."""
    joined = F.regexp_replace(collapsed(text), rf"(?U)(?<=[{CJK}])\s+(?=[{CJK}])", "")
    return F.when(is_title, F.regexp_replace(joined, TITLE_NUMBER, "$1 ")).otherwise(joined)


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{CJK}]"))


def latin_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def is_fragment(text: Column) -> Column:
    """One character at most, symbols only, or up to three without CJK, letter or digit."""
    short = (F.length(text) <= 3) & (cjk_count(text) == 0) & ~text.rlike("[0-9A-Za-z]")
    return (F.length(text) <= 1) | text.rlike(SYMBOLS_ONLY) | short


def is_garbled(text: Column) -> Column:
    """Short, without CJK, and either eight Latin letters or six with a slashed abbreviation."""
    slashed = (F.length(text) <= 40) & (latin_count(text) >= 6) & text.rlike("[A-Z]{3,}/[A-Z]{2,}")
    return (F.length(text) <= GARBLED_UPTO) & (cjk_count(text) == 0) & ((latin_count(text) >= 8) | slashed)


def is_contents_line(text: Column) -> Column:
    """A dotted line or an ellipsis that ends in a number, if it is short."""
    dotted = text.rlike(DOTTED_LINE) | ((F.contains(text, F.lit("…")) | text.rlike(r"\.{4,}")) & text.rlike(r"(?U)\d+\s*$"))
    return dotted & (F.length(text) < TOC_BELOW)


def is_list_line(text: Column) -> Column:
    return text.rlike(LIST_LINE)


def is_watermark(text: Column) -> Column:
    found = F.lit(False)
    for pattern in WATERMARKS:
        found = found | text.rlike(f"(?Ui){pattern}")
    return found


def repeats_end(before: str, text: str) -> bool:
    """Equal to the text before it, or its end and so much shorter that it is a leftover."""
    m, n = len(before), len(text)
    if not m or not n or not before.endswith(text):
        return False
    return n == m or n <= max(m // 2, 8) or (n < 40 and n < 0.6 * m)


def token_count(text: Column) -> Column:
    """A CJK character counts as a token, and so does each run of other characters without white space."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"(?U)[{CJK}]|[^\s\x1C-\x1F{CJK}]+"), F.lit(0)))


def has_protocol_code(text: Column) -> Column:
    return text.rlike(PROTOCOL_CODE) | text.rlike(PROTOCOL_RUN)


def tags_stripped(html_text: Column) -> Column:
    return collapsed(F.regexp_replace(html_text, r"<[^>]+>", " "))


def is_poor_table(html_text: Column) -> Column:
    """Empty, or several rows of Latin text with hardly any CJK."""
    text = unescaped(F.regexp_replace(html_text, r"<[^>]+>", " "))
    rows = F.regexp_count(html_text, F.lit(r"(?i)<tr\b"))
    cjk, latin = cjk_count(text), latin_count(text)
    mostly = (rows >= 2) & (cjk < 4) & (latin >= 20) & (latin > 5 * cjk)
    return (collapsed(text) == "") | mostly | ((rows >= 3) & (cjk == 0) & (latin >= 15))


def access_groups(groups: Column) -> Column:
    """The allowed ones of an array of groups; the first group of all if none is left."""
    trimmed = F.transform(F.coalesce(groups, F.array().cast("array<string>")), lambda g: stripped(g))  # noqa: PLW0108
    allowed = F.filter(trimmed, lambda g: g.isin(ACCESS_GROUPS))
    return F.when(F.size(allowed) > 0, allowed).otherwise(F.array(F.lit(ACCESS_GROUPS[0])))


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def page_number(page_idx: Column) -> Column:
    return page_idx + 1


def matches_keywords(text: Column, keywords: Column, mode: Column) -> Column:
    """Whether any, or all, of the keywords occur, regardless of case; false without keywords."""
    holds = lambda k: F.contains(F.lower(text), F.lower(k))
    found = F.when(mode == "all", F.forall(keywords, holds)).otherwise(F.exists(keywords, holds))
    return F.coalesce(F.when(F.size(keywords) > 0, found), F.lit(False))


def for_embedding(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
