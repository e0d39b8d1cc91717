"""Ranked lexical search: postings by term joined with the items' terms, scored in whole numbers, summed, ranked.

Postings are a table of their own, (term, row, doc_id, tf, n), dealt into buckets by term. A term that more than
``HOT`` documents hold is dealt by document instead: its postings fill many buckets, and as all hot terms of a document lie
in one, most of their sums are made before the shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import parts_for, sized_broadcast, stored
from lodestack.llm.plain_words import stretches

#: Documents that hold a term from which on it counts as hot, postings of a bucket, and rows that are broadcast at most
#: (terms of some 10 bytes with a number or two).
HOT, IN_A_BUCKET, TERMS_SENT = 4_000, 2_000_000, 200_000
#: Postings that a task hands on at once.
AT_ONCE = 200_000
POSTING = "term string, row long, doc_id long, tf long, n long"


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document and term that it holds: term, row, doc_id, tf, n; and one with the empty term for each document.

    ``tf`` counts the term's occurrences, ``n`` all the document's; the row with the empty term has tf 0 and stands for the
    document, for n may be 0. ``row`` tells rows of ``docs`` apart: it holds as long as the table isn't read anew, so
    it must be stored before it is used twice. Null texts hold no term. Each text is counted whole.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "row", "doc_id", "tf", "n"]
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in names]
            for row, doc_id, raw in zip(rows, ids, batch.column(2), strict=True):
                tf: Counter = Counter()
                for words in stretches(raw.as_py() or b""):
                    tf.update(words)
                n, many = tf.total(), len(tf) + 1
                for column, values in zip(out, ([b"", *tf], [row] * many, [doc_id] * many, [0, *tf.values()], [n] * many), strict=True):
                    column += values
                if len(out[0]) >= AT_ONCE:
                    yield _batch(out, names)
                    out = [[] for _ in names]
            yield _batch(out, names)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(counted, POSTING)


def _batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], names)


def terms_of(items: DataFrame, text: str = "text") -> DataFrame:
    """(item, item_id, term) for each item and each term that it holds, once each. Rows with the same id and text are one item."""
    each = stored(items.select("item_id", F.col(text).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "items")

    @F.arrow_udf("array<string>")
    def distinct(texts: pa.Array) -> pa.Array:
        found = [sorted({w for words in stretches(t.as_py() or b"") for w in words}) for t in texts]
        return pa.array([[w.decode() for w in f] for f in found], pa.list_(pa.string()))

    return each.select("item", "item_id", F.explode(distinct(F.col("text").cast("binary"))).alias("term"))


def bucketed(posted: DataFrame, frequencies: DataFrame, rows: int, terms: int) -> DataFrame:
    """``posted``, ``rows`` postings, dealt into buckets: by term, and by document for hot ones; within a bucket by term. Stored.

    ``frequencies`` (term, df) has every term, ``terms`` at most; of these as many can be hot as ``rows`` holds ``HOT``.
    """
    hot = frequencies.where(F.col("df") >= HOT).select("term", F.lit(True).alias("hot"))
    told = posted.join(sized_broadcast(hot, min(terms, rows // HOT), TERMS_SENT), "term", "left")
    dealt = F.when(F.col("hot"), F.xxhash64("row")).otherwise(F.xxhash64("term"))
    parts = parts_for(posted.sparkSession, rows, IN_A_BUCKET)
    return stored(told.select(*posted.columns, dealt.alias("bucket")).repartition(parts, "bucket").drop("bucket").sortWithinPartitions("term", "row"), "postings")


def scored(documents: int, length: int) -> Column:
    """What a posting (tf, n) of a term of weight ``w`` adds to a score, in 64-bit whole numbers; ``documents`` hold ``length`` terms in all."""
    m = f"(100L - 90L + (90L * n * {documents}L) div {max(1, length)}L)"
    return F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 8L * {m}))")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents (doc_id, text) of each item (item_id, text).

    Only documents with a score above 0 count; equal scores stand by doc_id, nulls last, then by the row's place. Each row
    of ``docs`` is a document of its own; rows of ``items`` with the same id and text are one item, those with the same id and
    other texts are items each. Null and wordless texts find nothing and aren't found, empty tables give no rows, other
    columns play no part. Every posting of an item's terms is scored: none are pruned or capped.

    Terms that no item holds are dropped before anything is shuffled; that is all which the items decide about the
    postings. They are broadcast if they are counted and few, else joined by a shuffle. Of what is summed, a task hands on
    its own best ``k`` of each item alone for the ranking.
    """
    asked = stored(terms_of(items), "item-terms")
    many = asked.count()
    vocabulary = asked.select("term").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    held = stored(postings(docs).join(sized_broadcast(vocabulary, many + 1, TERMS_SENT), "term", "left_semi").select("term", "row", "doc_id", "tf", "n"), "held-postings")
    total = held.where("term = '' and n > 0").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    held = held.where("term <> ''")
    frequencies = stored(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term-frequencies")
    table = bucketed(held, frequencies, frequencies.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0], many)
    documents, length = total["documents"], total["length"]
    weight = F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1)))
    wanted = asked.join(sized_broadcast(frequencies, many, TERMS_SENT), "term").select("term", "item", weight.alias("w"))
    ids = stored(asked.select("item", "item_id").distinct(), "item-ids")
    matches = table.join(sized_broadcast(wanted, many, TERMS_SENT), "term")
    sums = matches.select("item", "row", "doc_id", scored(documents, length).alias("score")).groupBy("item", "row", "doc_id").agg(F.sum("score").alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    ranked = sums.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(sized_broadcast(ids, many, TERMS_SENT), "item").select("item_id", "rank", "doc_id", "score")
