"""The vector index as a table that follows its chunks: only what changed is embedded, what went leaves a tombstone.

A base table and a table of later rows make up the index. A row of the later table stands in place of the base's row of its
chunk; with ``gone`` it takes that one away. When the later table has grown to a share of the base, both become a new base.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.sources.shared import settled
from lodestack.sources.store import Store

#: Share of the base that the later table has at most, and keys that are broadcast at most.
MOST_LATER, KEYS_SENT = 0.25, 500_000
OWN = ["text_hash", "row_hash", "vector", "norm"]


def norm_of(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _hashed(chunks: DataFrame, embedded: Column) -> DataFrame:
    """``chunks`` with the text to embed, its hash, and the hash of all that is told of the chunk."""
    told = F.to_json(F.struct(*(c for c in sorted(chunks.columns) if c != "chunk_text")))
    return chunks.select("*", embedded.alias("embedded")).withColumns({"text_hash": F.sha2("embedded", 256), "row_hash": F.sha2(F.concat_ws("\n", told, F.coalesce("chunk_text", F.lit(""))), 256)})


def _sent(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= KEYS_SENT else keys


def merged(base: DataFrame, later: DataFrame) -> DataFrame:
    """The index that ``base`` and ``later`` (its columns and ``gone``) make up; ``later`` has a row for a chunk at most."""
    kept = base.join(_sent(later.select("chunk_id")), "chunk_id", "left_anti")
    return kept.unionByName(later.where("not gone").drop("gone"), allowMissingColumns=True)


def changes(index: DataFrame, chunks: DataFrame, embedded: Column, vectorise: Callable[[Column], Column]) -> DataFrame:
    """The rows that turn ``index`` into that of ``chunks`` (chunk_id, unique, and any columns), with ``gone`` and ``state``.

    ``state`` is ``embedded`` for a text that the index doesn't have yet, ``carried`` for a row that is new or told otherwise but
    whose text has a vector already, under whatever chunk, ``gone`` for a chunk that is no more. Rows that are as they were
    aren't among them. A text that several chunks have is embedded once. The result is stored: it is worked out once.
    """
    wanted = _hashed(chunks, embedded)
    old = index.select("chunk_id", F.col("row_hash").alias("old_hash"))
    # The text to embed is told by the row's other columns: it isn't stored beside them.
    fresh = settled(wanted.drop("embedded").join(old, "chunk_id", "left").where("old_hash is null or old_hash <> row_hash").drop("old_hash"), "changed-chunks")
    texts = fresh.withColumn("embedded", embedded).groupBy("text_hash").agg(F.first("embedded").alias("embedded"))
    known = index.join(_sent(texts.select("text_hash")), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("vector").alias("vector"), F.first("norm").alias("norm"))
    known = settled(known.withColumn("state", F.lit("carried")), "known-vectors")
    new = texts.join(known.select("text_hash"), "text_hash", "left_anti").withColumn("vector", vectorise(F.col("embedded")))
    vectors = known.unionByName(new.select("text_hash", "vector", norm_of(F.col("vector")).alias("norm"), F.lit("embedded").alias("state")))
    told = fresh.join(settled(vectors, "chunk-vectors"), "text_hash").withColumn("gone", F.lit(False))
    went = index.select("chunk_id").join(wanted.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit("gone").alias("state"), F.lit(True).alias("gone"))
    return settled(told.unionByName(went, allowMissingColumns=True), "index-changes")


class Index:
    """An index named ``name`` in ``store``."""

    def __init__(self, store: Store, name: str = "index"):
        self.store, self.base, self.later = store, name, f"{name}_later"

    def there(self) -> bool:
        return self.store.there(self.base)

    def read(self) -> DataFrame:
        base = self.store.read(self.base)
        return merged(base, self.store.read(self.later)) if self.store.there(self.later) else base

    def refresh(self, chunks: DataFrame, embedded: Column, vectorise: Callable[[Column], Column]) -> DataFrame:
        """Makes the index that of ``chunks``, all of them, and gives how many rows were embedded, carried and gone (state, n)."""
        return self.follow(self.delta(chunks, embedded, vectorise))

    def delta(self, chunks: DataFrame, embedded: Column, vectorise: Callable[[Column], Column]) -> DataFrame:
        """The rows that would turn the index into that of ``chunks`` (see ``changes``)."""
        types = dict(chunks.dtypes)
        empty = "chunk_id string, text_hash string, row_hash string, vector array<double>, norm double".replace("string", types["chunk_id"], 1)
        return changes(self.read() if self.there() else self.store.spark.createDataFrame([], empty), chunks, embedded, vectorise)

    def follow(self, delta: DataFrame) -> DataFrame:
        """Takes up a delta of the index as it is, and gives how many rows were embedded, carried and gone (state, n)."""
        counts = settled(delta.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "index-counts")
        rows = delta.drop("state")
        if not self.there():
            self.store.write(self.base, rows.where("not gone").drop("gone"))
            return counts
        before = self.store.read(self.later) if self.store.there(self.later) else rows.limit(0)
        # Later rows that this delta doesn't name stay; tombstones too, as the base may hold the chunk.
        later = settled(before.join(_sent(rows.select("chunk_id")), "chunk_id", "left_anti").unionByName(rows, allowMissingColumns=True), "index-later")
        if later.count() <= MOST_LATER * self.store.read(self.base).count():
            self.store.write(self.later, later)
        else:
            # In this order: a later table that outlives its base being renewed gives the same rows once more.
            self.store.write(self.base, merged(self.store.read(self.base), later))
            self.store.write(self.later, later.limit(0))
        return counts
