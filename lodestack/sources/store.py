"""Keyed tables as Parquet: replace by key, upsert, append, snapshots.

A table is a folder of Parquet files, dealt into buckets by the hash of its key, which split as it grows. What replaces rows rewrites the buckets of
its keys alone, by Spark's dynamic partition overwrite. Keyed tables have one writer at a time; snapshots and runs, which are
appended under ids that their writers claim, may have several.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.functions.text import content_hash
from lodestack.sources.shared import settled


class NoChunks(ValueError):
    """A snapshot of no chunks was asked for."""


class DuplicateLabel(ValueError):
    """The label of a snapshot is taken."""


def replaced(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` without the rows whose keys ``new`` has, and ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def last_of_each(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """For each key the row with the largest ordinal, which is dropped."""
    others = [c for c in rows.columns if c not in (key, ordinal)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), ordinal).alias("r")).select(key, "r.*").select(*(c for c in rows.columns if c != ordinal))


def upserted(old: DataFrame, new: DataFrame, key: str, ordinal: str) -> DataFrame:
    """``old`` with ``new``'s rows in place of its own by key; of several in one batch the last by ordinal counts."""
    return replaced(old, last_of_each(new, key, ordinal), key)


def in_order_of(rows: DataFrame, column: str, n: int, newest_first: bool = True) -> DataFrame:
    return rows.orderBy(F.desc(column) if newest_first else F.asc(column)).limit(n)


def missing(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested keys that aren't known."""
    return requested.join(known.select(key), key, "left_anti")


def of_documents(rows: DataFrame, doc_ids: list[str] | None) -> DataFrame:
    """Chunks of these documents; null and an empty list both mean all. By document and place."""
    found = rows.where(F.col("doc_id").isin(doc_ids)) if doc_ids else rows
    return found.orderBy("doc_id", "chunk_index")


def documents_named(rows: DataFrame, doc_ids: list[str]) -> DataFrame:
    """The documents of these ids, by id; an empty list names none."""
    return rows.where(F.col("doc_id").isin(doc_ids) if doc_ids else F.lit(False)).orderBy("doc_id")


def document(rows: DataFrame, doc_id: str) -> DataFrame:
    """The document of this id: a row or none."""
    return documents_named(rows, [doc_id]).limit(1)


def cases_of(cases: DataFrame, case_ids: list[str] | None) -> DataFrame:
    """The cases named, enabled or not; all enabled ones if none is named."""
    return cases.where(F.col("case_id").isin(case_ids)) if case_ids else cases.where("enabled")


def snapshot(chunks: DataFrame, freeze_id: Column) -> DataFrame:
    """Items of a snapshot: each chunk with the hash of its text."""
    return chunks.select(freeze_id.alias("freeze_id"), "doc_id", "chunk_index", F.col("chunk_id").alias("source_chunk_id"), "chunk_text", content_hash(F.col("chunk_text")).alias("content_hash"))


def preview(items: DataFrame, n: int = 5, chars: int = 120) -> DataFrame:
    """The first items of each snapshot by document and place, their texts shortened."""
    first = Window.partitionBy("freeze_id").orderBy("doc_id", "chunk_index")
    return items.withColumn("n", F.row_number().over(first)).where(F.col("n") <= n).select("freeze_id", "doc_id", "chunk_index", "content_hash", F.left("chunk_text", F.lit(chars)).alias("preview"))


#: Rows of a bucket of a keyed table, and bits of a key's hash that tell buckets apart at most.
IN_A_BUCKET, MOST_BITS = 1_000_000, 24
#: Bytes of a bucket that a task writes.
IN_A_TASK = 64 << 20
BUCKET, SPLIT = "_bucket", "_split-"


def bytes_of(rows: DataFrame) -> Column:
    """About how many bytes a row's values have."""
    plain = {"string", "binary"}
    told = lambda c, t: F.octet_length(F.col(f"`{c}`") if t in plain else F.col(f"`{c}`").cast("string")) if t in plain or "<" in t or t == "variant" else F.lit(8)
    return sum((F.coalesce(told(c, t), F.lit(0)).cast("long") for c, t in rows.dtypes), F.lit(0).cast("long"))


class Store:
    """Tables by name below a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str, schema: StructType | str | None = None) -> DataFrame:
        """The table as it is; without one an empty table of ``schema``."""
        if not self.there(name):
            if schema is None:
                raise LookupError(f"no table {name}")
            return self.spark.createDataFrame([], schema)
        rows, dead = self.spark.read.option("mergeSchema", "true").parquet(self._at(name)), self.buckets(name)[1]
        return (rows.where(~F.col(BUCKET).isin(dead)) if dead else rows).drop(BUCKET)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` in place of the whole table. They are stored aside first, as they may come from it."""
        (settled(rows, name) if self.there(name) else rows).write.mode("overwrite").parquet(self._at(name))
        return self.read(name)

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def buckets(self, name: str) -> tuple[list[str], list[str]]:
        """The buckets that count, and those that don't: one that has been split (its mark says so), and parts of one that hasn't yet."""
        fs, path = self._fs(name)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        there = {n.removeprefix(f"{BUCKET}=") for n in names if n.startswith(f"{BUCKET}=")}
        split = {n.removeprefix(SPLIT) for n in names if n.startswith(SPLIT)}
        live = [b for b in there if b not in split and not any(b[:k] in there and b[:k] not in split for k in range(1, len(b)))]
        return sorted(live), sorted(there - set(live))

    def replace(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` in place of those with their keys; other buckets than theirs stay as they are.

        A bucket is a prefix of the keys' hash bits. One that would have more than ``IN_A_BUCKET`` rows is split into longer
        prefixes as it is written, so a table has as many buckets as its size asks for, and what a write rewrites stays bounded;
        only the rows of one key can't be split. The bucket that was split counts until its mark stands, its parts count
        from then on: readers have the one or the other.
        """
        bits = F.lpad(F.bin(F.shiftrightunsigned(F.xxhash64(key), 64 - MOST_BITS)), MOST_BITS, "0")
        live, dead = self.buckets(name)
        by_length = {n: [b for b in live if len(b) == n] for n in sorted({len(b) for b in live})}
        prefix = lambda n: F.concat(F.lit("b"), F.substring("_bits", 1, n))
        # Where a hash has no bucket yet, none of those that there are begins with as many of its bits as the longest has.
        home = F.coalesce(*(F.when(prefix(n - 1).isin(own), prefix(n - 1)) for n, own in by_length.items()), prefix(max(by_length, default=1) - 1))
        fresh = settled(rows.withColumn("_bits", bits).withColumn(BUCKET, home), name)
        touched = sorted({r[0] for r in fresh.select(BUCKET).distinct().collect()})
        if live:
            stored = self.spark.read.option("mergeSchema", "true").parquet(self._at(name))
            old = stored.where(F.col(BUCKET).isin(touched)).withColumn(BUCKET, F.col(BUCKET).cast("string")).withColumn("_bits", bits)
            fresh = settled(replaced(old, fresh, key), name)
        told = fresh.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), F.sum(bytes_of(fresh.drop(BUCKET, "_bits"))).alias("bytes")).collect()
        sizes = {r[BUCKET]: r["n"] for r in told}
        deeper = {b: min(MOST_BITS, len(b) - 1 + (n // IN_A_BUCKET).bit_length()) for b, n in sizes.items() if n > IN_A_BUCKET}
        deeper = {b: n for b, n in deeper.items() if n > len(b) - 1}
        target = F.coalesce(*(F.when(F.col(BUCKET).isin([b for b in deeper if deeper[b] == n]), prefix(n)) for n in sorted(set(deeper.values()))), F.col(BUCKET))
        # Rows of a bucket stand together, so a bucket has few files; one with very many rows or long ones is dealt over several tasks.
        tasks = {r[BUCKET]: max(-(-r["n"] // IN_A_BUCKET), -(-r["bytes"] // IN_A_TASK)) for r in told}
        several = F.coalesce(*(F.when(F.col(BUCKET).isin([b for b in tasks if tasks[b] == n]), F.lit(n)) for n in sorted({*tasks.values()} - {1})), F.lit(1))
        fresh = fresh.withColumns({BUCKET: target, "_task": (F.rand(7) * several).cast("int")}).drop("_bits").repartition(BUCKET, "_task").drop("_task")
        fs, path = self._fs(name)
        for b in dead:  # what a lost driver has left: parts of a split that never counted, or the rest of one that does
            fs.delete(path.suffix(f"/{BUCKET}={b}"), True)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self._at(name))
        for b in deeper:
            fs.create(path.suffix(f"/{SPLIT}{b}"), True).close()
            fs.delete(path.suffix(f"/{BUCKET}={b}"), True)
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, key: str, ordinal: str) -> DataFrame:
        return self.replace(name, last_of_each(rows, key, ordinal), key)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Adds ``rows``. They are written aside and their files renamed into the table: two writers that committed in one folder
        would take each other's unfinished files away. Files have names of their own, and one is there as a whole or not at all.
        """
        aside = self._at(f"_aside/{uuid.uuid4().hex}")
        rows.write.parquet(aside)
        path, table = (self.spark._jvm.org.apache.hadoop.fs.Path(p) for p in (aside, self._at(name)))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(table)
        for f in fs.listStatus(path):
            if f.getPath().getName().startswith("part-") and not fs.rename(f.getPath(), table):
                raise OSError(f"{f.getPath()} could not be renamed into {name}")
        fs.delete(path, True)
        return self.read(name)

    def claimed(self, name: str) -> bool:
        """Whether ``name`` is this writer's from now on: its file was made here, and no other writer had made it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(f"_claims/{name}"))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(path.getParent())
        if fs.getScheme() == "file":  # whose own create looks first and makes the file then
            try:
                os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            fs.create(path, False).close()
        except Exception:
            if fs.exists(path):
                return False
            raise
        return True

    def release(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(f"_claims/{name}"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)

    def new_id(self, kind: str, last: int) -> int:
        """The first number after ``last`` that no writer has claimed yet: it is claimed."""
        while not self.claimed(f"{kind}-{(last := last + 1)}"):
            pass
        return last

    def freeze(self, label: str, chunks: DataFrame, created_at: Column, note: str | None = None, pipeline_version: str | None = None) -> int:
        """Snapshots ``chunks`` under a label that isn't taken and tells the snapshot's id.

        Label and id are claimed before anything is written, so of several writers one has the label and each an id of its own.
        The head is written last: items that a failure leaves behind belong to no snapshot. A failure gives the label back;
        where the driver itself is lost, ``release`` of the label's claim does.
        """
        claim = f"label-{hashlib.sha256(label.encode()).hexdigest()}"
        if not self.claimed(claim):
            raise DuplicateLabel(label)
        try:
            if self.read("freezes", FREEZE).where(F.col("freeze_label") == label).limit(1).count():
                raise DuplicateLabel(label)
            return self._frozen(label, chunks, created_at, note, pipeline_version)
        except DuplicateLabel:
            raise
        except Exception:
            self.release(claim)
            raise

    def _frozen(self, label: str, chunks: DataFrame, created_at: Column, note: str | None, pipeline_version: str | None) -> int:
        heads = self.read("freezes", FREEZE)
        last = heads.select("freeze_id").unionByName(self.read("freeze_items", "freeze_id long").select("freeze_id")).agg(F.max("freeze_id")).first()[0]
        freeze_id = self.new_id("freeze", last or 0)
        items = settled(snapshot(chunks, F.lit(freeze_id).cast("long")), "snapshot")
        n = items.agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("chunks")).first()
        if not n["chunks"]:
            raise NoChunks("there are no chunks to freeze")
        self.append("freeze_items", items)
        told = {"freeze_id": freeze_id, "freeze_label": label, "note": note, "pipeline_version": pipeline_version, "doc_count": n["docs"], "chunk_count": n["chunks"]}
        self.append("freezes", self.spark.range(1).select(*(F.lit(v).cast(self.spark.createDataFrame([], FREEZE).schema[k].dataType).alias(k) for k, v in told.items()), created_at.cast("timestamp").alias("created_at")))
        return freeze_id


FREEZE = "freeze_id long, freeze_label string, note string, pipeline_version string, doc_count long, chunk_count long, created_at timestamp"
