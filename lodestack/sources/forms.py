"""Blocks, reports and metadata as JSON, and back: what is stored as text in one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of blocks, and the counts of a report in their order.
BLOCK_TYPES = ["title", "paragraph", "list_item", "table"]
COUNTS = [
    "element_count", "dropped_elements", "dropped_fragments", "dropped_garbled", "table_count", "table_quality_failed", "merged_continuations",
    "title_count", "paragraph_count", "list_item_count", "paragraph_block_count",
]
BLOCK_JSON = "array<struct<type:string,order:int,text:string,html:string,logical_table_id:string,page_idx:int,bbox:array<double>,text_level:int>>"
REPORT_JSON = f"struct<{','.join(f'{c}:int' for c in COUNTS)}>"


def _int(v: Column, path: str) -> Column:
    """A whole number, one written as text, or the whole part of another number; null for what isn't one."""
    return F.coalesce(F.try_variant_get(v, path, "string").try_cast("int"), F.try_variant_get(v, path, "double").try_cast("int"))


def blocks_json(blocks: Column) -> Column:
    """An array of blocks (see ``BLOCK_JSON``) as JSON text; fields without value are left out."""
    return F.to_json(F.coalesce(blocks, F.array().cast(BLOCK_JSON)))


def blocks_of_json(told: Column) -> Column:
    """Blocks by order from JSON text: entries of unknown type are dropped, what isn't a list has none.

    A missing order is 0. Pages and levels that aren't numbers are null, and so are boxes without four numbers.
    """

    def block(v: Column) -> Column:
        text = lambda name: F.try_variant_get(v, f"$.{name}", "string").alias(name)
        box = F.try_variant_get(v, "$.bbox", "array<double>")
        return F.struct(
            F.trim(F.try_variant_get(v, "$.type", "string")).alias("type"), F.coalesce(_int(v, "$.order"), F.lit(0)).alias("order"), text("text"), text("html"), text("logical_table_id"),
            _int(v, "$.page_idx").alias("page_idx"), F.when((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull()), box).alias("bbox"), _int(v, "$.text_level").alias("text_level"),
        )

    entries = F.coalesce(F.try_variant_get(F.try_parse_json(told), "$", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(entries, lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    blocks = F.filter(F.transform(objects, block), lambda b: b["type"].isin(BLOCK_TYPES))
    # A stable sort: of equal orders the one that stands first comes first.
    placed = F.array_sort(F.transform(blocks, lambda b, i: F.struct(b["order"].alias("order"), i.alias("i"), b.alias("b"))))
    return F.transform(placed, lambda p: p["b"])


def report_of_json(told: Column) -> Column:
    """Counts (see ``COUNTS``) from JSON text, 0 where one is missing; null for what isn't an object.

    Of paragraph_count and its former name paragraph_block_count one stands in for the other.
    """
    v = F.try_parse_json(told)
    count = lambda *names: F.coalesce(*(_int(v, f"$.{n}") for n in names), F.lit(0))
    other = {"paragraph_count": ("paragraph_block_count",), "paragraph_block_count": ("paragraph_count",)}
    counts = F.struct(*(count(c, *other.get(c, ())).alias(c) for c in COUNTS))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), counts)


def metadata_of_json(told: Column) -> Column:
    """JSON text of an object as it is; null for any other."""
    return F.when(F.schema_of_variant(F.try_parse_json(told)).startswith("OBJECT"), told)


def extracted_of(rows: DataFrame) -> DataFrame:
    """Stored documents with ``blocks``, ``extract_report`` and ``metadata`` read from JSON text; a missing report counts nothing."""
    none = F.struct(*(F.lit(0).alias(c) for c in COUNTS))
    return rows.withColumns({"blocks": blocks_of_json(F.col("blocks")), "extract_report": F.coalesce(report_of_json(F.col("extract_report")), none), "metadata": metadata_of_json(F.col("metadata"))})


def cases_of_rows(rows: DataFrame) -> DataFrame:
    """Stored cases as they are scored: a missing expect_hit is true, a missing mode any."""
    return rows.withColumns({"expect_hit": F.coalesce("expect_hit", F.lit(True)), "keyword_match_mode": F.coalesce("keyword_match_mode", F.lit("any"))})
