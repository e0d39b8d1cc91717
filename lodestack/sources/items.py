"""Reading parsed page items: JSON files of a document each, flat or by page."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.shared import settled

#: Paths that one listing of chosen files has.
PATHS_AT_ONCE = 50_000


def _string(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def spans_text(spans: object) -> str:
    """The text of nested spans, one after the other: a string itself, else its content if that is a string, else its children, however deep."""
    parts, left = [], [spans]
    while left:
        x = left.pop()
        if isinstance(x, list):
            left.extend(reversed(x))
        elif isinstance(x, dict):
            left.append(x["children"] if "children" in x and not isinstance(x.get("content"), str) else x.get("content"))
        elif x is not None:
            parts.append(x if isinstance(x, str) else json.dumps(x))
    return "".join(parts)


def _loaded(text: str) -> object:
    """JSON with its numbers as they are written."""
    return json.loads(text, parse_int=str, parse_float=str)


def _strings(v: Column, path: str) -> Column:
    """An array of strings, or one string as such an array; entries that are objects give their text or content."""
    entry = lambda x: F.coalesce(_string(x, "$.text"), _string(x, "$.content"), F.try_variant_get(x, "$", "string"))
    many = F.transform(F.try_variant_get(v, path, "array<variant>"), entry)
    return F.coalesce(many, F.when(_string(v, path).isNotNull(), F.array(_string(v, path))))


def _flat(v: Column, page: Column) -> Column:
    return F.struct(
        _string(v, "$.type").alias("type"), _string(v, "$.text").alias("text"), _string(v, "$.text_level").alias("text_level"), _strings(v, "$.list_items").alias("list_items"),
        _string(v, "$.table_body").alias("table_body"), _string(v, "$.html").alias("html"), _strings(v, "$.table_caption").alias("table_caption"),
        F.coalesce(_string(v, "$.page_idx"), page).alias("page_idx"), F.try_variant_get(v, "$.bbox", "array<double>").alias("bbox"),
    )


def _paged(v: Column, page: Column) -> Column:
    """An item of the form by page as a flat one; the type is null for types without content."""

    @F.arrow_udf("string")
    def told(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else spans_text(_loaded(t)) for t in texts.to_pylist()], pa.string())

    @F.arrow_udf("array<string>")
    def told_each(texts: pa.Array) -> pa.Array:
        lists = (None if t is None else _loaded(t) for t in texts.to_pylist())
        return pa.array([[spans_text(x) for x in v] if isinstance(v, list) else None for v in lists], pa.list_(pa.string()))

    kind, null = F.lower(_string(v, "$.type")), F.lit(None).cast("string")
    inside = lambda path: F.to_json(F.try_variant_get(v, path, "variant"))
    spans = F.when(kind == "title", inside("$.content.title_content")).when(kind == "paragraph", inside("$.content.paragraph_content"))
    text = F.when(kind.isin("title", "paragraph"), F.coalesce(told(spans), F.lit("")))
    level = F.when(kind == "title", F.coalesce(F.nullif(_string(v, "$.content.level"), F.lit("0")), F.lit("1"))).when(kind == "paragraph", "0")
    entries = told_each(F.when(kind.isin("list", "index"), inside("$.content.list_items")))
    return F.struct(
        F.when(kind.isin("title", "paragraph"), "text").when(kind.isin("list", "index"), "list").when(kind == "table", "table").alias("type"), text.alias("text"), level.alias("text_level"),
        F.when(kind.isin("list", "index"), F.filter(entries, lambda x: F.trim(x) != "")).alias("list_items"), F.coalesce(_string(v, "$.content.table_body"), _string(v, "$.content.html")).alias("table_body"), null.alias("html"),
        F.coalesce(_strings(v, "$.content.table_caption"), _strings(v, "$.content.captions")).alias("table_caption"), page.alias("page_idx"), F.try_variant_get(v, "$.bbox", "array<double>").alias("bbox"),
    )


def items_of(texts: DataFrame) -> DataFrame:
    """Items of ``texts`` (doc_id, json): a list of items, or a list of pages that are lists of items. Entries that aren't objects are left out."""
    root = texts.select("doc_id", F.try_parse_json("json").alias("root"))
    top = root.select("doc_id", F.posexplode(F.try_variant_get("root", "$", "array<variant>")).alias("page", "v"))
    is_page = F.schema_of_variant("v").startswith("ARRAY")
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    flat = top.where(is_object("v")).select("doc_id", F.col("page").alias("at"), F.lit(0).alias("sub"), _flat(F.col("v"), F.lit(None).cast("string")).alias("i"))
    paged = top.where(is_page).select("doc_id", "page", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("sub", "w")).where(is_object("w"))
    paged = paged.select("doc_id", F.col("page").alias("at"), "sub", _paged(F.col("w"), F.col("page").cast("string")).alias("i")).where("i.type is not null")
    both = flat.unionByName(paged)
    # Both places are ints: one above the other in a long, so no number of items or pages runs over.
    return both.select("doc_id", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("sub")).alias("pos"), "i.*")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of the files ``*_content_list.json`` below ``path``, else of ``*_v2.json``; the folder's name is the doc_id.

    Of several such files in a folder the first by name counts.
    """
    # Chosen by path alone: the listing reads no contents, and only the files chosen are opened.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    rank = F.struct(F.col("file").endswith("_v2.json"), F.col("file"))
    named = listed.where(F.col("file").rlike(r"_content_list\.json$|_v2\.json$")).withColumn("doc_id", F.element_at(F.split("file", "/"), -2))
    chosen = settled(named.groupBy("doc_id").agg(F.min_by("file", rank).alias("file")), "chosen-files")
    blocks, texts = -(-chosen.count() // PATHS_AT_ONCE), None
    for b in range(blocks):
        paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r[0]) for r in chosen.where(F.pmod(F.xxhash64("file"), F.lit(blocks)) == b).select("file").collect()]
        some = spark.read.option("wholetext", "true").text(paths).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("doc_id"), F.col("value").alias("json")) if paths else None
        texts = some if texts is None else texts if some is None else texts.unionByName(some)
    return items_of(spark.createDataFrame([], "doc_id string, json string") if texts is None else texts)
