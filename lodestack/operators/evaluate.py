"""Scoring retrieval on labelled cases: evidence, relevance, hit, recall, reciprocal rank, run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import matches_keywords
from lodestack.operators.anchors import holding
from lodestack.operators.retrieval import present

DEFAULT_TOP_K = 3


def top_k_of(request: int | None, case: Column | None = None) -> Column:
    """The request's, else the case's, else the default."""
    return F.coalesce(F.lit(request).cast("int"), *([] if case is None else [case]), F.lit(DEFAULT_TOP_K))


def most_frequent_top_k(cases: DataFrame, request: int | None = None) -> DataFrame:
    """One row ``top_k``: the request's, else the one that most cases have, the larger of equally frequent ones, else the default."""
    counts = cases.where("top_k is not null").groupBy("top_k").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("top_k", F.struct("n", "top_k")).alias("best")).select(F.coalesce(F.lit(request).cast("int"), F.col("best").cast("int"), F.lit(DEFAULT_TOP_K)).alias("top_k"))


def evidence_pairs(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, key_pos, chunk_id, chunk_doc, chunk_index) for each chunk that fits an evidence key.

    ``keys``: case_id, key_pos, anchor_text, doc_id, content_hash; ``chunks``: chunk_id, doc_id, chunk_index, chunk_text, content_hash.
    A key fits if its doc_id is null or the chunk's, and its hash is the chunk's regardless of case or its anchor stands in the text.
    """
    k = keys.select("case_id", "key_pos", F.nullif(F.trim("anchor_text"), F.lit("")).alias("anchor"), F.col("doc_id").alias("key_doc"), F.lower(F.nullif(F.trim("content_hash"), F.lit(""))).alias("hash"))
    c = chunks.select("chunk_id", F.col("doc_id").alias("chunk_doc"), "chunk_index", F.lower("content_hash").alias("chunk_hash"))
    out = ["case_id", "key_pos", "chunk_id", "chunk_doc", "chunk_index"]
    same_doc = F.col("key_doc").isNull() | (F.col("key_doc") == F.col("chunk_doc"))
    by_hash = k.where("hash is not null").join(c, (F.col("hash") == F.col("chunk_hash")) & same_doc).select(*out)
    held = holding(chunks, k.where("anchor is not null").select("anchor"))
    by_anchor = held.join(k, "anchor").join(c, "chunk_id").where(same_doc).select(*out)
    return by_hash.unionByName(by_anchor).distinct()


def resolved_ids(pairs: DataFrame) -> DataFrame:
    """(case_id, resolved): chunk ids of each case, once each, by the first key that found them, then document and index."""
    first = pairs.groupBy("case_id", "chunk_id").agg(F.min(F.struct("key_pos", "chunk_doc", "chunk_index")).alias("at"))
    lists = first.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("chunk_id").cast("string").alias("id")))).alias("found"))
    return lists.select("case_id", F.col("found.id").alias("resolved"))


def merged_ids(explicit: Column, resolved: Column) -> Column:
    """Both lists, trimmed, without blanks and repeats, in order; null if nothing is left."""
    none = F.array().cast("array<string>")
    both = F.transform(F.concat(F.coalesce(explicit, none), F.coalesce(resolved, none)), lambda x: F.trim(x))  # noqa: PLW0108
    kept = F.array_distinct(F.filter(both, lambda x: x != ""))
    return F.when(F.size(kept) > 0, kept)


def is_relevant() -> Column:
    """A retrieved row's relevance by its case: in the id list, or holding the keywords; ids alone decide where there are no keywords."""
    by_id = F.coalesce(F.array_contains("relevant_chunk_ids", F.col("chunk_id").cast("string")), F.lit(False))
    by_word = matches_keywords(F.col("chunk_text"), F.col("expected_keywords"), F.col("keyword_match_mode"))
    return by_id | by_word


def score_cases(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """hit, recall and mrr of each case over its retrieved rows (case_id, rank, chunk_id, chunk_text).

    A positive case hits if a row is relevant; its recall is the share of its ids that were retrieved, its mrr one over the first
    relevant rank. A negative case hits if no row is relevant, and its recall and mrr are 0.
    """
    labels = cases.select("case_id", "relevant_chunk_ids", "expected_keywords", "keyword_match_mode", F.coalesce("expect_hit", F.lit(True)).alias("expect_hit"), F.size(F.array_distinct("relevant_chunk_ids")).alias("n_ids"))
    rows = labels.join(retrieved.select("case_id", "rank", "chunk_id", "chunk_text"), "case_id", "left").withColumn("relevant", F.coalesce(is_relevant(), F.lit(False)))
    return _scored(rows.withColumn("by_id", F.array_contains("relevant_chunk_ids", F.col("chunk_id").cast("string"))))


def score_pairs(cases: DataFrame, relevant: DataFrame, retrieved: DataFrame) -> DataFrame:
    """As ``score_cases`` by ids alone, which stand in rows: no case's ids are gathered.

    ``cases``: case_id, n_ids (how many ids it has), expect_hit; ``relevant``: a row (case_id, chunk_id) for each id, of which those
    that weren't retrieved can be missing; ``retrieved``: case_id, rank, chunk_id.
    """
    by_id = relevant.select("case_id", "chunk_id").distinct().withColumn("by_id", F.lit(True))
    found = retrieved.select("case_id", "rank", "chunk_id").join(by_id, ["case_id", "chunk_id"], "left")
    labels = cases.select("case_id", "n_ids", F.coalesce("expect_hit", F.lit(True)).alias("expect_hit"))
    return _scored(labels.join(found, "case_id", "left").withColumn("relevant", F.coalesce("by_id", F.lit(False))))


def _scored(rows: DataFrame) -> DataFrame:
    """Scores of the cases' retrieved rows, each with by_id and relevant; a case without any has one of nulls."""
    told = rows.groupBy("case_id").agg(
        F.first("expect_hit").alias("expect_hit"), F.max("n_ids").alias("n_ids"),
        F.countDistinct(F.when(F.col("by_id"), F.col("chunk_id"))).alias("n_found"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"),
        F.count("chunk_id").alias("n_retrieved"),
    )
    hit = F.col("first_rank").isNotNull()
    recall = F.when(F.col("expect_hit") & (F.col("n_ids") > 0), F.col("n_found") / F.col("n_ids")).otherwise(0.0)
    mrr = F.when(F.col("expect_hit") & hit, 1 / F.col("first_rank")).otherwise(0.0)
    return told.select("case_id", (F.col("expect_hit") == hit).cast("int").alias("hit"), recall.alias("recall"), mrr.alias("mrr"), "n_retrieved")


def summary(scores: DataFrame) -> DataFrame:
    """dataset_size and the means of hit, recall and mrr, and of latency_ms where it is known; 0 without cases."""
    known = [c for c in ("hit", "recall", "mrr", "latency_ms") if c in scores.columns]
    return scores.agg(F.count(F.lit(1)).alias("dataset_size"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in known))


def usable(chunks: DataFrame) -> DataFrame:
    """Chunks whose id, document and text aren't blank."""
    return chunks.where(present("chunk_id", "doc_id", "chunk_text"))
