"""Chunking documents: sections of typed blocks, title paths, text and table pieces, and the chunks' metadata.

A document is the unit of order; windows and folds never reach beyond it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.functions.batches import sliced
from lodestack.functions.split import PIECES, recursive_split, sections_split, tidy_pieces
from lodestack.functions.tables import tables_split

BLOCK = "doc_id string, order int, type string, text string, html string, logical_table_id string, page_idx int, bbox array<double>, text_level int"


@dataclass(frozen=True)
class ChunkSettings:
    """Lengths in characters."""

    chunk_size: int = 500
    chunk_overlap: int = 20
    min_chunk_chars: int = 20
    section_soft_max: int | None = 1000


def title_paths(titles: Column) -> Column:
    """The path (titles from the outermost to the own one) after each of an array of structs (title, level); as many as titles.

    A title takes those of its level and below off the stack before it goes on it. Its level is one more than the dots of a
    leading number; without one it is 0 on an empty stack, else the given level, 1 at least, else the stack's depth.
    """

    @F.arrow_udf("array<array<string>>")
    def paths(lists: pa.Array) -> pa.Array:
        return sliced(lambda t: None if t is None else _paths([(x["title"], x["level"]) for x in t]), pa.list_(pa.list_(pa.string())), lists)

    return paths(titles)


def _paths(titles: list[tuple[str, int | None]]) -> list[list[str]]:
    stack: list[tuple[int, str]] = []
    out = []
    for title, given in titles:
        number = re.match(T.LEADING_NUMBER.removeprefix("(?U)"), title)
        level = number[1].count(".") + 1 if number else 0 if not stack else max(given, 1) if given is not None else len(stack)
        stack = [*(s for s in stack if s[0] < level), (level, title)]
        out.append([t for _, t in stack])
    return out


def islands(blocks: DataFrame) -> DataFrame:
    """Blocks that aren't blank with ``section``: a table is one, and so is a run of titles with the texts up to the next title."""
    own = blocks.withColumn("text", T.stripped(F.coalesce("text", F.lit("")))).where("type = 'table' or (type in ('title', 'paragraph', 'list_item') and text <> '')")
    by_order = Window.partitionBy("doc_id").orderBy("order")
    before = F.lag("type").over(by_order)
    starts = before.isNull() | (before == "table") | (F.col("type") == "table") | ((F.col("type") == "title") & (before != "title"))
    return own.withColumn("starts", starts.cast("int")).withColumn("section", F.sum("starts").over(by_order)).drop("starts")


def _span(html: Column) -> tuple[Column, Column]:
    """First and last page of a table's ``data-page-span``; nulls without numbers there."""
    page = lambda k: F.regexp_extract(html, r'data-page-span="(\d+)-(\d+)"', k).try_cast("int")
    return page(1), page(2)


def sections(blocks: DataFrame) -> DataFrame:
    """A row for each section: header, body, html, prefix (titles right before a table), pages, box, path of titles."""
    rows = islands(blocks)
    page = F.when(F.col("page_idx") >= 0, F.col("page_idx"))
    one = rows.groupBy("doc_id", "section").agg(
        F.max(F.col("type") == "table").alias("is_table"),
        F.array_sort(F.collect_list(F.struct("order", "type", "text", "text_level"))).alias("parts"),
        F.first("html", True).alias("html"), F.first("logical_table_id", True).alias("logical_table_id"),
        F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.collect_set("bbox").alias("boxes"),
    )
    of = lambda titles: F.filter("parts", lambda p: (p["type"] == "title") == titles)
    text = lambda parts: F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")
    titles = F.transform(of(F.lit(True)), lambda p: F.struct(p["text"].alias("title"), p["text_level"].alias("level")))
    one = one.withColumn("titles", F.when(F.col("is_table"), F.array().cast("array<struct<title:string,level:int>>")).otherwise(titles))
    one = one.withColumn("header", F.when(~F.col("is_table"), F.nullif(text(of(F.lit(True))), F.lit("")))).withColumn("body", F.when(~F.col("is_table"), text(of(F.lit(False)))))
    by_section = Window.partitionBy("doc_id").orderBy("section")
    only_titles = ~F.col("is_table") & (F.col("body") == "")
    one = one.withColumn("goes_to_table", only_titles & F.coalesce(F.lead("is_table").over(by_section), F.lit(False)))
    one = one.withColumn("prefix", F.when(F.col("is_table") & F.lag("goes_to_table").over(by_section), F.lag("header").over(by_section)))
    # One fold over a document's titles gives the path after each; a section has that after the titles up to its own.
    one = one.withColumn("so_far", F.sum(F.size("titles")).over(by_section))
    folded = one.where(F.size("titles") > 0).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section", "titles"))), lambda s: s["titles"])).alias("all"))
    paths = folded.select("doc_id", F.posexplode(title_paths(F.col("all"))).alias("k", "path")).select("doc_id", (F.col("k") + 1).cast("long").alias("so_far"), "path")
    one = one.join(paths, ["doc_id", "so_far"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))
    a, b = _span(F.col("html"))
    first = F.when(F.col("is_table") & a.isNotNull(), a).otherwise(F.col("first_page"))
    last = F.when(F.col("is_table") & a.isNotNull(), b).otherwise(F.col("last_page"))
    return one.select(
        "doc_id", "section", "is_table", "header", "body", "html", "logical_table_id", "prefix", "goes_to_table", "path",
        T.page_number(F.least(first, last)).alias("page_num"), T.page_number(F.greatest(first, last)).alias("page_end"), F.when(F.size("boxes") == 1, F.col("boxes")[0]).alias("bbox"),
    )


def _pieces(one: DataFrame, settings: ChunkSettings) -> DataFrame:
    s = settings
    common = ["doc_id", "section", "path", "page_num", "page_end", "bbox"]
    nothing = {"table_row_start": "int", "table_row_end": "int", "table_cols": "int", "logical_table_id": "string"}
    texts = one.where("not is_table and not goes_to_table")
    texts = texts.withColumn("split", sections_split(F.col("header"), F.col("body"), s.chunk_size, s.chunk_overlap, s.min_chunk_chars, s.section_soft_max))
    texts = texts.select(*common, "header", "split.cut", F.posexplode("split.pieces").alias("pos", "chunk_text"))
    title = F.coalesce(F.try_element_at("path", F.lit(-1)), F.element_at(F.split("header", "\n\n"), -1))
    texts = texts.select(*common, "pos", "chunk_text", F.lit("paragraph").alias("chunk_kind"), F.when(F.col("cut"), s.chunk_overlap).otherwise(0).alias("chunk_overlap"), title.alias("section_title"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    tables = one.where("is_table").withColumn("split", tables_split(F.col("html"), F.col("prefix"), s.chunk_size))
    tables = tables.select(*common, "logical_table_id", F.posexplode("split").alias("pos", "p"))
    tables = tables.select(*common, "pos", F.col("p.text").alias("chunk_text"), F.col("p.kind").alias("chunk_kind"), F.lit(0).alias("chunk_overlap"), F.try_element_at("path", F.lit(-1)).alias("section_title"), F.col("p.row_start").alias("table_row_start"), F.col("p.row_end").alias("table_row_end"), F.col("p.cols").alias("table_cols"), "logical_table_id")
    return texts.unionByName(tables)


def _whole_texts(docs: DataFrame, settings: ChunkSettings) -> DataFrame:
    """Pieces of documents without blocks, from their full text."""
    s = settings

    @F.arrow_udf("pieces array<string>, cut boolean")
    def split(texts: pa.Array) -> pa.Array:
        cut = lambda t: recursive_split(t or "", s.chunk_size, s.chunk_overlap)
        return sliced(lambda t: (lambda p: {"pieces": tidy_pieces(p, s.min_chunk_chars), "cut": len(p) > 1})(cut(t)), PIECES, texts)

    told = docs.withColumn("split", split("full_text")).select("doc_id", "split.cut", F.posexplode("split.pieces").alias("pos", "chunk_text"))
    null = {"page_num": "int", "page_end": "int", "bbox": "array<double>", "section_title": "string", "table_row_start": "int", "table_row_end": "int", "table_cols": "int", "logical_table_id": "string"}
    return told.select("doc_id", F.lit(1).cast("long").alias("section"), F.array().cast("array<string>").alias("path"), "pos", "chunk_text", F.lit("full_text_fallback").alias("chunk_kind"), F.when(F.col("cut"), s.chunk_overlap).otherwise(0).alias("chunk_overlap"), *(F.lit(None).cast(t).alias(c) for c, t in null.items()))


def linked(chunks: DataFrame) -> DataFrame:
    """``chunks`` in their order (doc_id, section, pos) with chunk_index from 0 and the neighbours' indexes."""
    by_place = Window.partitionBy("doc_id").orderBy("section", "pos")
    out = chunks.withColumn("chunk_index", F.row_number().over(by_place) - 1)
    return out.withColumns({"prev_chunk_index": F.lag("chunk_index").over(by_place), "next_chunk_index": F.lead("chunk_index").over(by_place)})


def attributes(docs: DataFrame) -> DataFrame:
    """What chunks take over from their document: doc_id, file_path, source, category, doc_version, access_group, create_time, update_time, metadata.

    Each comes from the column of its name if ``docs`` has it, else from that key of the JSON object in ``metadata``; blank
    ones are null. Groups may be a list or one text. Times are those of the metadata, else created_at and updated_at.
    """
    has, told = set(docs.columns), F.try_parse_json("metadata" if "metadata" in docs.columns else F.lit(None).cast("string"))
    own = lambda name, type_="string": F.col(name).cast(type_) if name in has else F.lit(None).cast(type_)
    given = lambda name: F.nullif(F.coalesce(own(name), F.try_variant_get(told, f"$.{name}", "string")), F.lit(""))
    said = lambda name: F.when(T.stripped(given(name)) != "", given(name)).alias(name)
    listed = F.when(F.schema_of_variant(F.try_variant_get(told, "$.access_group", "variant")).startswith("ARRAY"), F.try_variant_get(told, "$.access_group", "array<string>"))
    groups = F.coalesce(listed, F.array(F.try_variant_get(told, "$.access_group", "string")))
    if "access_group" in has:
        groups = F.coalesce("access_group" if dict(docs.dtypes)["access_group"].startswith("array") else F.array("access_group"), groups)
    time = lambda name, at: F.coalesce(F.nullif(F.try_variant_get(told, f"$.{name}", "string"), F.lit("")), T.iso_seconds(own(at, "timestamp"))).alias(name)
    return docs.select(
        "doc_id", said("file_path"), said("source"), said("category"), T.stripped(said("doc_version")).alias("doc_version"), T.access_groups(groups).alias("access_group"),
        time("create_time", "created_at"), time("update_time", "updated_at"), own("metadata").alias("metadata"),
    )


def chunk_documents(docs: DataFrame, blocks: DataFrame, settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """Chunks of ``docs`` (doc_id, full_text and attributes) from their ``blocks`` (see ``BLOCK``), or from the full text without blocks.

    What a chunk takes over from its document is told in ``attributes``; other keys of the metadata stay in its ``metadata``.
    A chunk's id is a hash of its document, place and text, so other documents' chunks keep theirs.
    Documents that give no chunk are not in the result (see ``without_chunks``).
    """
    bare = docs.join(blocks.select("doc_id").distinct(), "doc_id", "left_anti")
    pieces = _pieces(sections(blocks.join(docs.select("doc_id"), "doc_id", "left_semi")), settings).unionByName(_whole_texts(bare, settings))
    pieces = pieces.withColumn("chunk_text", T.stripped(F.col("chunk_text"))).where("chunk_text <> ''")
    of_doc = attributes(docs)
    told = linked(pieces).join(of_doc, "doc_id")
    return told.select(
        F.substring(F.sha2(F.concat_ws("\x1f", "doc_id", "chunk_index", "chunk_text"), 256), 1, 16).alias("chunk_id"), "doc_id", "chunk_index", "chunk_text", "chunk_kind",
        F.length("chunk_text").alias("char_count"), T.token_count(F.col("chunk_text")).alias("token_count"), "chunk_overlap", "prev_chunk_index", "next_chunk_index",
        T.has_protocol_code(F.col("chunk_text")).alias("has_protocol_code"), "page_num", "page_end", F.coalesce(F.col("page_end") > F.col("page_num"), F.lit(False)).alias("is_cross_page"), "bbox",
        F.col("path").alias("full_section_path"), "section_title", F.try_element_at("path", F.lit(-2)).alias("parent_section"),
        F.when(F.col("chunk_kind").startswith("table"), "markdown").alias("table_format"), "logical_table_id", "table_cols", "table_row_start", "table_row_end", *of_doc.columns[1:],
    )


def without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that gave no chunk: neither blocks nor text had any content."""
    return docs.select("doc_id").join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
