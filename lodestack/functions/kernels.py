"""Splitting as table functions: pieces leave a task as they are cut, none waits for the others of its text.

``recursive_pieces(text, size, overlap)`` and ``table_pieces(html, prefix, size)`` are called by LATERAL, in SQL after ``register`` or
through ``lateralJoin``. They are of the form that goes to and fro in Arrow batches but is called by row: Spark refuses those
that take whole Arrow arrays on the right of a lateral join. ``pieces_of_tables(TABLE(rows), size)`` takes whole batches, which
is several times as fast where there are many small tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestack.functions.batches import ROWS
from lodestack.functions.split import each_piece
from lodestack.functions.tables import PIECE, each_table_piece

#: Pieces of tables that leave a task at once.
PIECES_AT_ONCE = 1_000


@F.udtf(returnType="pos int, piece string", useArrow=True)
class recursive_pieces:  # noqa: N801
    """(pos, piece) of a text as ``split.recursive_split`` cuts it; null gives none."""

    def eval(self, text: str | None, size: int, overlap: int) -> Iterator[tuple]:
        yield from enumerate(each_piece(text or "", size, overlap))


@F.udtf(returnType="pos int, text string, kind string, row_start int, row_end int, cols int", useArrow=True)
class table_pieces:  # noqa: N801
    """(pos, text, kind, row_start, row_end, cols) of a table as ``tables.pieces`` gives them."""

    def eval(self, html: str | None, prefix: str | None, size: int) -> Iterator[tuple]:
        for pos, p in enumerate(each_table_piece(html, prefix, size)):
            yield pos, p["text"], p["kind"], p["row_start"], p["row_end"], p["cols"]


_PIECES = pa.schema([("table_id", pa.int64()), ("pos", pa.int32()), *PIECE])


@F.arrow_udtf(returnType="table_id long, pos int, text string, kind string, row_start int, row_end int, cols int")
class pieces_of_tables:  # noqa: N801
    """As ``table_pieces`` of each row (table_id, html, prefix) of a table argument."""

    def eval(self, rows: pa.RecordBatch, size: pa.Array) -> Iterator[pa.RecordBatch]:
        told, most = [], size[0].as_py()
        for k in range(0, rows.num_rows, ROWS):
            for table_id, html, prefix in zip(*(rows.column(c).slice(k, ROWS).to_pylist() for c in ("table_id", "html", "prefix")), strict=True):
                for pos, p in enumerate(each_table_piece(html, prefix, most)):
                    told.append({"table_id": table_id, "pos": pos, **p})
                    if len(told) == PIECES_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(told, _PIECES)
                        told = []
        yield pa.RecordBatch.from_pylist(told, _PIECES)


def register(spark: SparkSession) -> None:
    """Makes them known to SQL under their names."""
    spark.udtf.register("recursive_pieces", recursive_pieces)
    spark.udtf.register("table_pieces", table_pieces)
    spark.udtf.register("pieces_of_tables", pieces_of_tables)
