"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import mixing, ngram_join, quality_rules, queries, secret_scans
from lodestack.llm.common import quoted, sized_broadcast, stored
from lodestack.sources.shared import Passing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = quality_rules.learn(docs, queries.table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select(*quoted(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, of several texts under it that with the smallest hash.

    Ids may repeat: a row goes for its text, not for its id. Rows that share id and text are one text, of which one row
    stays. Rows without id or without words belong to no group and stay. Only keys of rows that go, or that
    repeat, are sent round or shuffled with the texts.
    """
    key = ["doc_id", "text_id"]
    joined = stored(ngram_join.join(docs.select("doc_id", "text")).where("group_id is not null").groupBy(*key, "group_id").agg(F.count(F.lit(1)).alias("rows")), "near-groups")
    # Stored: then both sides of the join are shuffled for it alone, and Spark can split a group of very many copies.
    first = stored(joined.groupBy("group_id").agg(F.min(F.struct(*key)).alias("kept")), "near-firsts")
    told = joined.join(first, "group_id").select(*key, (F.struct(*key) == F.col("kept")).alias("stays"), "rows")
    marked = stored(told.where("not stays or rows > 1"), "near-copies")
    n = marked.count()
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), "doc_id", ngram_join.text_id())
    stays = rows.join(sized_broadcast(marked.select(*key), n, ngram_join.IDS_SENT), key, "left_anti").select("row")
    repeated = rows.join(sized_broadcast(marked.where("stays").select(*key), n, ngram_join.IDS_SENT), key, "left_semi")
    # Map-side, a task makes one row of those that it has.
    return stays.unionByName(repeated.groupBy(*key).agg(F.first("row").alias("row")).select("row")).select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live credentials in their texts masked."""
    scanned = queries.scanned(docs, keep_text=True)
    masked = scanned.withColumn("text", secret_scans.masked(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*quoted(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order."""
    sized = docs.withColumn("size", mixing.words(F.col("text")))
    return mixing.training_order(mixing.mix(sized), docs.count()).select(*quoted(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every copy."""
    return queries.byte_bpe(docs)


STAGES = [
    ("quality rules", judge_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The learned rules, the order by hash and the tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage needed goes once its result is stored, and so does the result before."""
    docs, passing = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), Passing(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
            passing.drop()
    return docs
