"""From parsed page items to clean, typed blocks, a document's full text and a report of what was dropped."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.functions.batches import sliced
from lodestack.functions.tables import captioned, goes_on, joined, with_id
from lodestack.sources.shared import settled

ITEM = (
    "doc_id string, pos bigint, type string, text string, text_level string, list_items array<string>, table_body string, html string, table_caption array<string>, page_idx string, bbox array<double>"
)
#: Item types without content for retrieval.
DROPPED_TYPES = ["image", "chart", "equation", "code", "header", "footer", "page_number", "aside_text", "page_footnote", "page_header", "page_footer", "page_aside_text"]
TEXT_TYPES = ["text", "title", "paragraph"]


def nodes_of(items: DataFrame) -> DataFrame:
    """A row for each node of ``items`` (see ``ITEM``): doc_id, pos, sub, type, text, page_idx, bbox, text_level, dropped.

    ``dropped`` is ``other`` for items that give no node, which stay as rows to be counted. A list gives a node for each entry;
    with only blank entries it is dropped, and without entries its own text counts. Levels and pages that aren't numbers, and
    negative pages, are null; so is a box without four numbers.
    """

    @F.arrow_udf("string")
    def table_html(bodies: pa.Array, captions: pa.Array) -> pa.Array:
        return sliced(lambda b, c: captioned(b or "", c or []), pa.string(), bodies, captions)

    kind, own = F.lower(F.trim(F.coalesce("type", F.lit("")))), T.stripped(F.coalesce("text", F.lit("")))
    level, page = F.col("text_level").try_cast("int"), F.col("page_idx").try_cast("int")
    entries = F.filter(F.transform(F.coalesce("list_items", F.array().cast("array<string>")), lambda x: T.stripped(F.coalesce(x, F.lit("")))), lambda x: x != "")
    listed = F.when(F.size(F.coalesce("list_items", F.array().cast("array<string>"))) > 0, entries).when(own != "", F.array(own)).otherwise(F.array().cast("array<string>"))
    html = table_html(F.coalesce(F.nullif("table_body", F.lit("")), "html"), F.col("table_caption"))
    texts = F.when(kind == "list", listed).when(kind == "table", F.filter(F.array(html), lambda x: x != "")).when(kind.isin(TEXT_TYPES) & (own != ""), F.array(own)).otherwise(F.array().cast("array<string>"))
    node_type = F.when(kind == "list", "list_item").when(kind == "table", "table").when((kind == "title") | ((kind == "text") & (F.coalesce(level, F.lit(0)) >= 1)), "title").otherwise("paragraph")
    rows = items.select(
        "doc_id", "pos", node_type.alias("type"), F.posexplode_outer(texts).alias("sub", "text"), F.when(page >= 0, page).alias("page_idx"),
        F.when((F.size("bbox") == 4) & F.forall("bbox", lambda x: x.isNotNull()), F.col("bbox")).alias("bbox"), F.when(kind.isin(TEXT_TYPES), level).alias("text_level"),
    )
    return rows.withColumn("dropped", F.when(F.col("text").isNull(), "other")).withColumn("sub", F.coalesce("sub", F.lit(0)))


def _worked_out(nodes: DataFrame, **columns: Column) -> DataFrame:
    """``nodes`` with these columns, through a generator of one row: what filters on them later doesn't work them out again."""
    kept = [c for c in nodes.columns if c not in columns]
    return nodes.select(*kept, F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def _suffix_copies(types: list[str], texts: list[str], dropped: list[str | None]) -> list[bool]:
    """For each node of a document in order whether it repeats the end of the last text kept before it; tables begin anew."""
    last, out = "", []
    for kind, text, gone in zip(types, texts, dropped, strict=True):
        copy = gone is None and kind != "table" and T.repeats_end(last, text)
        out.append(copy)
        if gone is None and not copy:
            last = "" if kind == "table" else text
    return out


def _folded(types: list[str], texts: list[str], dropped: list[str | None]) -> list[dict]:
    """For each node of a document ``copy`` (see ``_suffix_copies``) and ``copies`` (see ``with_copies``)."""
    copy = _suffix_copies(types, texts, dropped)
    short = [text if gone is None and not again and kind != "table" and text is not None and len(text) <= T.SHORT_REPEATED else None for kind, text, gone, again in zip(types, texts, dropped, copy, strict=True)]
    n = Counter(short)
    return [{"copy": again, "copies": None if text is None else n[text]} for again, text in zip(copy, short, strict=True)]


def _without_suffix_copies(nodes: DataFrame) -> DataFrame:
    """Marks a text that repeats the end of the last text kept before it, and tells ``copies`` as ``with_copies`` does.

    What was kept decides about what comes next, so a document's nodes are gathered, folded in order, and dealt out again.
    """

    @F.arrow_udf("array<struct<copy:boolean,copies:bigint>>")
    def folded(types: pa.Array, texts: pa.Array, dropped: pa.Array) -> pa.Array:
        return sliced(_folded, pa.list_(pa.struct([("copy", pa.bool_()), ("copies", pa.int64())])), types, texts, dropped)

    others = [c for c in nodes.columns if c not in ("doc_id", "pos", "sub")]
    of = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", *others))).alias("n"))
    told = of.select("doc_id", F.inline(F.arrays_zip("n", folded("n.type", "n.text", "n.dropped").alias("f"))))
    dropped = F.coalesce("n.dropped", F.when(F.col("f.copy"), "fragment")).alias("dropped")
    return told.select(*(dropped if c == "dropped" else "doc_id" if c == "doc_id" else f"n.{c}" for c in nodes.columns), "f.copies")


def with_copies(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``copies``: of a short text that is left, how often it stands in its document; null for others."""
    short = F.col("dropped").isNull() & (F.col("type") != "table") & (F.length("text") <= T.SHORT_REPEATED)
    return nodes.withColumn("copies", F.when(short, F.count(F.when(short, 1)).over(Window.partitionBy("doc_id", "text"))))


def cleaned(nodes: DataFrame) -> DataFrame:
    """``nodes`` through the text rules in order; ``dropped`` tells which rule took a node away. Tables pass untouched."""
    is_table, text, left = F.col("type") == "table", F.col("text"), F.col("dropped").isNull()
    df = nodes.withColumn("text", F.when(is_table, text).otherwise(T.nfkc(text)))
    df = df.withColumn("text", F.when(is_table, text).otherwise(T.tidied(text, F.col("type") == "title")))
    why = F.when(~left | is_table, F.col("dropped")).when(text == "", "element").when(T.is_fragment(text), "fragment").when(T.is_garbled(text), "garbled")
    df = _without_suffix_copies(_worked_out(df, dropped=why))
    why = F.when(~left, F.col("dropped")).when(is_table, F.when(T.is_poor_table(text), "table"))
    why = why.when(F.col("copies") >= 2, "element").when(T.is_contents_line(text) | T.is_watermark(text), "element")
    kind = F.when((F.col("type") == "paragraph") & T.is_list_line(text), "list_item").otherwise(F.col("type"))
    return _worked_out(df, dropped=why, type=kind).drop("copies")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """Ordered blocks of the nodes that are left; adjacent tables of which one continues the other are one block.

    Columns as chunking reads them, and ``n_merged``, how many tables went into the block besides its first.
    """
    order = Window.partitionBy("doc_id").orderBy("pos", "sub")
    is_table = F.col("type") == "table"

    @F.arrow_udf("string")
    def numbered(html: pa.Array, numbers: pa.Array) -> pa.Array:
        return sliced(lambda h, n: None if h is None else with_id(h, f"tbl-{n:03d}"), pa.string(), html, numbers)

    def placed(columns: list[str | Column]) -> DataFrame:
        there = nodes.where("dropped is null").select("doc_id", "pos", "sub", "type", *columns)
        return there.withColumns({"place": F.row_number().over(order), "tables": F.sum(is_table.cast("int")).over(order)})

    # Tables are told apart without the texts between them. Runs of adjacent tables are gaps and islands; within a run a table is
    # held against what was merged so far.
    tables = placed([F.when(is_table, F.col("text")).alias("html"), F.when(is_table, F.col("page_idx")).alias("page_idx"), F.when(is_table, F.col("bbox")).alias("bbox")]).where(is_table)
    tables = tables.withColumns({"number": F.col("tables") - 1, "run": F.col("place") - F.col("tables")})
    tables = tables.withColumn("html", numbered("html", "number"))
    runs = tables.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("place", "html", "number", "page_idx", "bbox"))).alias("all"))

    @F.arrow_udf("array<struct<place:int,html:string,number:int,page_idx:int,bbox:array<double>,n_merged:int>>")
    def merged(rows: pa.Array) -> pa.Array:
        return sliced(_merged, pa.list_(_MERGED), rows)

    runs = settled(runs.select("doc_id", F.col("all.place").alias("places"), merged("all").alias("merged")), "tables")
    # A block's order is its node's place less the tables before it that went into others.
    gone = runs.select("doc_id", F.array_except("places", "merged.place").alias("gone")).where(F.size("gone") > 0).groupBy("doc_id").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    ordered = lambda rows: rows.join(gone, "doc_id", "left").withColumn("order", F.col("place") - 1 - F.coalesce(F.size(F.filter("gone", lambda p: p < F.col("place"))), F.lit(0)))
    tables = ordered(runs.select("doc_id", F.explode("merged").alias("t")).select("doc_id", "t.*"))
    tables = tables.select("doc_id", F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), "html", F.format_string("tbl-%03d", F.col("number")).alias("logical_table_id"), "page_idx", "bbox", F.lit(None).cast("int").alias("text_level"), "n_merged", "order")
    level = F.when(F.col("type") == "title", F.col("text_level"))
    null = F.lit(None).cast("string")
    texts = ordered(placed(["text", "page_idx", "bbox", "text_level"]).where(~is_table))
    return texts.select("doc_id", "type", "text", null.alias("html"), null.alias("logical_table_id"), "page_idx", "bbox", level.alias("text_level"), F.lit(0).alias("n_merged"), "order").unionByName(tables)


_MERGED = pa.struct([("place", pa.int32()), ("html", pa.string()), ("number", pa.int32()), ("page_idx", pa.int32()), ("bbox", pa.list_(pa.float64())), ("n_merged", pa.int32())])


def _merged(run: list[dict]) -> list[dict]:
    """A run of adjacent tables with each continuation joined to the table before it."""
    out: list[dict] = []
    for t in run:
        last = out[-1] if out else None
        if last is None or not goes_on(last["html"], t["html"]):
            out.append(t | {"n_merged": 0})
            continue
        moved = None not in (last["page_idx"], t["page_idx"]) and last["page_idx"] != t["page_idx"]
        last.update(html=joined(last["html"], t["html"]), bbox=None if moved or last["bbox"] != t["bbox"] else last["bbox"], n_merged=last["n_merged"] + 1)
    return out


def full_texts(blocks: DataFrame) -> DataFrame:
    """doc_id, full_text (blocks in order, HTML for tables, a blank line between), char_count, content_hash."""
    part = T.stripped(F.coalesce(F.when(F.col("type") == "table", F.col("html")).otherwise(F.col("text")), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct(F.col("order"), part.alias("part"))))
    text = F.array_join(F.filter(F.transform(parts, lambda p: p["part"]), lambda p: p != ""), "\n\n")
    told = blocks.groupBy("doc_id").agg(text.alias("full_text"))
    return told.select("doc_id", "full_text", F.length("full_text").alias("char_count"), T.content_hash(F.col("full_text")).alias("content_hash"))


def reports(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Counts of each document's blocks by type and of what was dropped. Fragments, garbled lines and failed tables count as elements too."""
    n = lambda c, name: F.count_if(c).cast("int").alias(name)
    why = F.col("dropped")
    dropped = nodes.groupBy("doc_id").agg(
        n(why == "other", "discarded_other"), n(why.isNotNull(), "dropped_elements"), n(why == "fragment", "dropped_fragments"),
        n(why == "garbled", "dropped_garbled"), n(why == "table", "table_quality_failed"),
    )
    kinds = blocks.groupBy("doc_id").agg(*(n(F.col("type") == t, f"{t}_count") for t in ("title", "paragraph", "list_item", "table")), F.sum("n_merged").cast("int").alias("table_merged_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return dropped.join(kinds, "doc_id", "left").select("doc_id", *(zero(c) for c in [*dropped.columns[1:], *kinds.columns[1:]]))


def page_counts(items: DataFrame) -> DataFrame:
    """doc_id and page_count: one more than the highest page, 1 without pages."""
    page = F.col("page_idx").try_cast("int")
    return items.groupBy("doc_id").agg(F.coalesce(F.max(F.when(page >= 0, page)) + 1, F.lit(1)).alias("page_count"))


def extract(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, full_text, char_count, content_hash, page_count and the report's counts) and their blocks.

    A document of which nothing is left has an empty full_text (see ``empty_documents``).
    """
    nodes = settled(cleaned(nodes_of(items)), "clean-nodes")
    blocks = settled(blocks_of(nodes), "blocks")
    texts = F.coalesce("full_text", F.lit(""))
    docs = page_counts(items).join(full_texts(blocks), "doc_id", "left").join(reports(nodes, blocks), "doc_id", "left")
    docs = docs.withColumns({"full_text": texts, "char_count": F.coalesce("char_count", F.lit(0)), "content_hash": F.coalesce("content_hash", T.content_hash(F.lit("")))})
    return docs, blocks


def empty_documents(docs: DataFrame) -> DataFrame:
    """Documents whose extraction left nothing: an error for whoever asked for them."""
    return docs.where("full_text = ''").select("doc_id")
