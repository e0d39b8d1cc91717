"""The operations of the retrieval service as methods on a store: extract, chunk, index, query, metrics, evaluation, snapshots.

What an operation gives is settled before it returns: its failures show there, as a ``ServiceError`` with a code.
"""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import for_embedding, stripped
from lodestack.functions.vectors import bigram_vector
from lodestack.operators import evaluate, extract, monitor, retrieval
from lodestack.operators.chunk import BLOCK, ChunkSettings, chunk_documents, without_chunks
from lodestack.operators.index import Index
from lodestack.sources.forms import cases_of_rows
from lodestack.sources.shared import settled
from lodestack.sources.store import FREEZE, DuplicateLabel, NoChunks, Store, cases_of, in_order_of, missing, of_documents, preview

# Codes of what can fail, of the operations as such and of what they ask for; bounds of what is asked.
CODES = {
    "extract": "DOCUMENT_EXTRACT_ERROR", "chunk": "CHUNK_INGEST_ERROR", "build_index": "INDEX_BUILD_ERROR", "query": "QUERY_EXECUTION_ERROR", "metrics": "METRICS_READ_ERROR",
    "upsert_cases": "EVAL_DATASET_UPSERT_ERROR", "cases": "EVAL_DATASET_READ_ERROR", "run_eval": "EVAL_RUN_ERROR", "runs": "EVAL_RUNS_READ_ERROR",
    "freeze": "CHUNK_FREEZE_CREATE_ERROR", "freezes": "CHUNK_FREEZE_LIST_ERROR", "freeze_detail": "CHUNK_FREEZE_READ_ERROR",
    "not_extracted": "DOCUMENT_NOT_EXTRACTED", "no_chunks": "NO_CHUNKS_FOR_INDEX", "not_ready": "INDEX_NOT_READY", "no_cases": "EVAL_DATASET_EMPTY",
    "no_freeze": "NO_CHUNKS_FOR_FREEZE", "label": "DUPLICATE_FREEZE_LABEL", "no_such_freeze": "CHUNK_FREEZE_NOT_FOUND", "invalid": "VALIDATION_ERROR",
}
CASE = (
    "case_id string, query_text string, relevant_chunk_ids array<string>, expected_keywords array<string>, evidence_keys array<struct<anchor_text:string,doc_id:string,content_hash:string>>,"
    " keyword_match_mode string, top_k int, enabled boolean, expect_hit boolean, filters string"
)
LOG = "query_text string, top_k int, embed_ms int, retrieve_ms int, total_ms int, retrieved_before_filter long, retrieved_after_filter long, filters_applied boolean, is_empty_recall boolean, top_score double, min_score_value double, avg_score double, error_code string, created_at timestamp"
RUN = "run_id long, dataset_size long, avg_hit double, avg_recall double, avg_mrr double, avg_latency_ms double, top_k int, note string, created_at timestamp"
CHUNK = "chunk_id string, doc_id string, chunk_index int, chunk_text string"
TOP_K, LISTED, ID_LENGTH, HASH_LENGTH, LEAST_MINUTES = (1, 20), (1, 100), 128, 64, 1
LABEL_LENGTH = 128

log = logging.getLogger(__name__)


class ServiceError(Exception):
    """Something asked for can't be done; ``code`` tells what."""

    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.code = CODES[reason]


def _operation(method: Callable) -> Callable:
    """Failures that have no code yet get that of the operation."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        try:
            return method(self, *args, **kwargs)
        except ServiceError:
            raise
        except Exception as e:
            raise ServiceError(method.__name__, str(e)) from e

    return run


def _within(value: int, bounds: tuple[int, int], name: str) -> int:
    if not bounds[0] <= value <= bounds[1]:
        raise ServiceError("invalid", f"{name} must be from {bounds[0]} to {bounds[1]}")
    return value


def _named(text: str, name: str, most: int = ID_LENGTH) -> str:
    """``text`` without white space at its ends, where something must be left."""
    text = text.strip()
    if not 0 < len(text) <= most:
        raise ServiceError("invalid", f"{name} must have 1 to {most} characters")
    return text


def _ids(ids: list[str] | None, name: str, least: int = 0) -> list[str] | None:
    if ids is not None and len(ids) < least:
        raise ServiceError("invalid", f"{name} must name something")
    return None if ids is None else [_named(i, name) for i in ids]


def _refuse(rows: DataFrame, wrong: Column, message: str) -> None:
    if rows.where(F.coalesce(wrong, F.lit(True))).limit(1).count():
        raise ServiceError("invalid", message)


def _blank(c: str) -> Column:
    return stripped(F.coalesce(c, F.lit(""))) == ""


@dataclass
class Service:
    """``embed_metadata`` puts a chunk's metadata before its text as ``key: value`` lines when it is embedded; ``index_source``, if
    given, stands for every chunk's source in the index."""

    spark: SparkSession
    store: Store
    settings: ChunkSettings = field(default_factory=ChunkSettings)
    min_score: float = 0.5
    vectorise: object = bigram_vector
    embed_metadata: bool = False
    index_source: str | None = None
    index: DataFrame | None = None

    def __post_init__(self):
        if not 0 <= self.min_score <= 1:
            raise ServiceError("invalid", "min_score must be from 0 to 1")

    def _now(self) -> Column:
        return F.current_timestamp()

    @_operation
    def extract(self, items: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        """Documents of parsed items, stored with their blocks; fails if one of them has no content.

        ``documents`` (doc_id, and optionally file_path and metadata, a JSON object as text) tells more of them.
        """
        _refuse(items.select("doc_id").distinct(), _blank("doc_id") | (F.length("doc_id") > ID_LENGTH), "a document has no proper doc_id")
        if documents is not None:
            told = [c for c in ("file_path", "metadata") if c in documents.columns]
            for c in told[:1] if told[:1] == ["file_path"] else []:
                _refuse(documents, _blank(c), "a document has no path")
            if "metadata" in told:
                _refuse(documents.where("metadata is not null"), ~F.schema_of_variant(F.try_parse_json("metadata")).startswith("OBJECT"), "metadata must be an object")
        docs, blocks = extract.extract(items)
        docs = docs if documents is None else docs.join(documents.select("doc_id", *told), "doc_id", "left")
        docs = settled(docs.withColumns({"created_at": self._now(), "updated_at": self._now()}), "documents")
        empty = [r[0] for r in extract.empty_documents(docs).limit(5).collect()]
        if empty:
            raise ServiceError("extract", f"nothing left of {', '.join(empty)}")
        self.store.replace("blocks", blocks, "doc_id")
        self.store.replace("documents", docs, "doc_id")
        return docs

    @staticmethod
    def extract_totals(docs: DataFrame) -> DataFrame:
        """extracted_doc_count, total_page_count, total_char_count of what ``extract`` gave."""
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return docs.agg(F.count(F.lit(1)).alias("extracted_doc_count"), total("page_count").alias("total_page_count"), total("char_count").alias("total_char_count"))

    @_operation
    def chunk(self, doc_ids: list[str]) -> DataFrame:
        """Chunks of stored documents, in place of those they had; all or none are written."""
        doc_ids = _ids(doc_ids, "doc_ids", 1)
        documents = self.store.read("documents", "doc_id string, full_text string, created_at timestamp")
        asked = self.spark.createDataFrame([(d,) for d in dict.fromkeys(doc_ids)], "doc_id string")
        absent = {r[0] for r in missing(asked, documents, "doc_id").collect()}
        if absent:
            raise ServiceError("not_extracted", f"not extracted: {', '.join(d for d in doc_ids if d in absent)}")
        docs = documents.join(asked, "doc_id", "left_semi")
        chunks = settled(chunk_documents(docs, self.store.read("blocks", BLOCK).join(asked, "doc_id", "left_semi"), self.settings), "chunks")
        if without_chunks(docs, chunks).limit(1).count():
            raise ServiceError("chunk", "a document gives no chunk")
        self.store.replace("chunks", chunks, "doc_id")
        return chunks

    def chunk_totals(self, doc_ids: list[str], chunks: DataFrame) -> DataFrame:
        """stored_doc_count and stored_chunk_count of a request that gave ``chunks``; an id that it names twice counts twice."""
        asked = self.spark.createDataFrame([(d.strip(),) for d in doc_ids], "doc_id string")
        counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        return asked.join(counts, "doc_id", "left").agg(F.count(F.lit(1)).alias("stored_doc_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("stored_chunk_count"))

    def _embedded_text(self, chunks: DataFrame) -> Column:
        if not self.embed_metadata:
            return F.col("chunk_text")
        names = [c for c in chunks.columns if c != "chunk_text"]
        values = F.map_entries(retrieval.values_of(names))
        text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
        lines = F.transform(F.filter(values, lambda e: e["value"].isNotNull()), lambda e: F.concat_ws(": ", e["key"], text(e["value"])))
        return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), "chunk_text")

    @_operation
    def build_index(self, doc_ids: list[str] | None = None) -> DataFrame:
        """Chunks with their vectors, which queries read from then on. Only texts that the index has no vector of are embedded (see ``operators.index``)."""
        chunks = of_documents(self._chunks(), _ids(doc_ids, "doc_ids"))
        if not chunks.limit(1).count():
            self.index = None
            raise ServiceError("no_chunks", "there are no chunks to index")
        if self.index_source is not None:
            chunks = chunks.withColumn("source", F.lit(self.index_source))
        kept = Index(self.store)
        kept.refresh(evaluate.usable(chunks), for_embedding(self._embedded_text(chunks)), self.vectorise)
        self.index = kept.read().drop("text_hash", "row_hash", "norm")
        return self.index

    def _chunks(self) -> DataFrame:
        return self.store.read("chunks", CHUNK)

    def _ready(self) -> DataFrame:
        if self.index is None:
            raise ServiceError("not_ready", "build the index first")
        return self.index

    @_operation
    def query(self, queries: DataFrame, top_k: int = 3, filters: dict[str, object] | None = None) -> DataFrame:
        """Ranked chunks for ``queries`` (query_id, query_text), logged with what was found; failures are logged too.

        A query's times are those of the batch that it came with.
        """
        _within(top_k, TOP_K, "top_k")
        _refuse(queries, _blank("query_text"), "a query has no text")
        try:
            index, began = self._ready(), time.time()
            asked = settled(queries.withColumn("vector", self.vectorise(for_embedding(stripped(F.col("query_text"))))), "asked")
            embedded = time.time()
            asked_of = index if "chunk_text" in (filters or {}) else index.drop("chunk_text")  # texts are joined to what is left
            condition = retrieval.matches(filters or {}, asked_of.dtypes)
            rows = settled(retrieval.fetched(asked, asked_of, top_k), "fetched")
            retrieved = time.time()
            kept = retrieval.filtered(rows, F.lit(True) if condition is None else condition, self.min_score, top_k)
            kept = kept if "chunk_text" in kept.columns else kept.join(index.select("chunk_id", "chunk_text"), "chunk_id")
            out = settled(kept.select("chunk_id", "query_id", "score", "rank", *(c for c in index.columns if c not in ("chunk_id", "vector"))), "found")
            told = retrieval.traced(asked, rows, top_k, condition, self.min_score)
            ms = [int(1000 * (b - a)) for a, b in ((began, embedded), (embedded, retrieved), (began, time.time()))]
        except Exception as e:
            self._log(queries, top_k, filters, (0, 0, 0), e.code if isinstance(e, ServiceError) else CODES["query"])
            raise
        self._log(queries.join(told, "query_id"), top_k, filters, ms)
        return out

    def _log(self, told: DataFrame, top_k: int, filters: dict | None, ms: tuple[int, int, int], error: str | None = None) -> None:
        """Appends a row for each query. What goes wrong here is not the query's failure."""
        has = set(told.columns)
        col = lambda c, t: (F.col(c) if c in has else F.lit(None)).cast(t).alias(c)
        count = lambda c: F.coalesce(col(c, "long"), F.lit(0)).alias(c)
        rows = told.select(
            "query_text", F.lit(top_k).alias("top_k"), *(F.lit(v).cast("int").alias(c) for c, v in zip(("embed_ms", "retrieve_ms", "total_ms"), ms, strict=True)),
            count("retrieved_before_filter"), count("retrieved_after_filter"), F.lit(bool(filters)).alias("filters_applied"), F.coalesce(col("is_empty_recall", "boolean"), F.lit(True)).alias("is_empty_recall"),
            col("top_score", "double"), col("min_score_value", "double"), col("avg_score", "double"), F.lit(error).cast("string").alias("error_code"), self._now().alias("created_at"),
        )
        try:
            self.store.append("query_logs", rows)
        except Exception:
            log.exception("the query log could not be written")

    @_operation
    def metrics(self, minutes: int | None = None) -> DataFrame:
        if minutes is not None and minutes < LEAST_MINUTES:
            raise ServiceError("invalid", f"minutes must be {LEAST_MINUTES} or more")
        return settled(monitor.metrics(self.store.read("query_logs", LOG), minutes), "metrics")

    def health(self) -> DataFrame:
        n = lambda df, c: df.agg(F.countDistinct(c)).first()[0]
        chunks, docs = self._chunks(), self.store.read("documents", "doc_id string")
        counts = (n(docs, "doc_id"), n(chunks, "doc_id"), chunks.count(), self.index is not None)
        return self.spark.createDataFrame([counts], "extracted_documents long, chunked_documents long, chunks long, index_ready boolean")

    @_operation
    def upsert_cases(self, cases: DataFrame, ordinal: str) -> DataFrame:
        """Cases by case_id (see ``CASE``; filters are a JSON object as text); each needs at least one kind of label."""
        n = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
        _refuse(cases, _blank("case_id") | (F.length("case_id") > ID_LENGTH) | _blank("query_text"), "a case has no id or no text")
        _refuse(cases, ~(n("relevant_chunk_ids") | n("expected_keywords") | n("evidence_keys")), "a case has no labels")
        blank = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: stripped(F.coalesce(x, F.lit(""))) == "")
        _refuse(cases, blank("relevant_chunk_ids") | blank("expected_keywords"), "a label is blank")
        empty = lambda x: stripped(F.coalesce(x, F.lit(""))) == ""
        bad_key = F.exists("evidence_keys", lambda k: (empty(k["anchor_text"]) & empty(k["content_hash"])) | (F.length(F.coalesce(k["content_hash"], F.lit(""))) > HASH_LENGTH))
        _refuse(cases, F.coalesce(bad_key, F.lit(False)), "an evidence key has neither anchor nor hash")
        _refuse(cases, ~F.coalesce(F.col("top_k").between(*TOP_K), F.lit(True)) | ~F.coalesce(F.col("keyword_match_mode").isin("any", "all"), F.lit(True)), "a case has no proper top_k or mode")
        if "filters" in cases.columns:
            _refuse(cases.where("filters is not null"), ~F.schema_of_variant(F.try_parse_json("filters")).startswith("OBJECT"), "filters must be an object")
        else:
            cases = cases.withColumn("filters", F.lit(None).cast("string"))
        return self.store.upsert("cases", cases, "case_id", ordinal).orderBy("case_id")

    @_operation
    def cases(self) -> DataFrame:
        return cases_of_rows(self.store.read("cases", CASE)).orderBy("case_id")

    @_operation
    def run_eval(self, case_ids: list[str] | None = None, top_k: int | None = None, note: str | None = None) -> DataFrame:
        """Scores of the cases, stored as a run; evidence is looked up in the chunks as they are now, and each case's filters hold.

        A case's latency is the time of the retrieval that it came with over the cases in it.
        """
        index = self._ready()
        if top_k is not None:
            _within(top_k, TOP_K, "top_k")
        cases = cases_of(self.cases(), _ids(case_ids, "case_ids"))
        if not cases.limit(1).count():
            raise ServiceError("no_cases", "there are no cases to run")
        keys = cases.select("case_id", F.posexplode("evidence_keys").alias("key_pos", "key")).select("case_id", "key_pos", "key.*")
        live = self._chunks().withColumn("content_hash", F.lit(None).cast("string"))
        resolved = evaluate.resolved_ids(evaluate.evidence_pairs(keys, live))
        cases = cases.join(resolved, "case_id", "left").withColumn("relevant_chunk_ids", F.when(F.size("evidence_keys") > 0, evaluate.merged_ids(F.col("relevant_chunk_ids"), F.col("resolved"))).otherwise(F.col("relevant_chunk_ids")))
        vector = self.vectorise(for_embedding(F.col("query_text")))
        cases = settled(cases.withColumns({"vector": vector, "k": evaluate.top_k_of(top_k, F.col("top_k"))}), "cases")
        asked = cases.select(F.col("case_id").alias("query_id"), "vector")
        n, most = cases.agg(F.count(F.lit(1)), F.max("k")).first()
        # One scan for all: a case with a smaller k has its own first rows among those of the largest.
        began = time.time()
        rows = settled(retrieval.fetched(asked, index, most), "fetched")
        ms = int(1000 * (time.time() - began) / n)
        rows = rows.join(cases.select(F.col("case_id").alias("query_id"), F.col("filters").alias("asked_for"), F.col("k").alias("case_k")), "query_id").where(F.col("rank") <= retrieval.OVER_FETCH * F.col("case_k"))
        part = retrieval.filtered(rows, retrieval.fits(retrieval.filters_of(F.col("asked_for")), retrieval.values_of(index.columns)), self.min_score, F.col("case_k"))
        found = settled(part.select(F.col("query_id").alias("case_id"), "rank", "chunk_id", "chunk_text"), "retrieved")
        ids = found.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("id")))).alias("ids"))
        scores = evaluate.score_cases(cases, found).drop("n_retrieved").withColumn("latency_ms", F.lit(ms)).join(cases.select("case_id", "query_text"), "case_id").join(ids, "case_id", "left")
        last = max(self.store.read(t, "run_id long").agg(F.max("run_id")).first()[0] or 0 for t in ("runs", "run_items"))
        run_id = self.store.new_id("run", last)
        scores = scores.withColumn("retrieved_chunk_ids", F.coalesce(F.col("ids.id"), F.array().cast("array<string>"))).drop("ids")
        items = settled(scores.withColumn("run_id", F.lit(run_id).cast("long")), "run-items")
        self.store.append("run_items", items)
        echo = evaluate.most_frequent_top_k(cases.select(F.col("k").alias("top_k")), top_k)
        head = evaluate.summary(items).join(F.broadcast(echo)).select(F.lit(run_id).cast("long").alias("run_id"), "*", F.lit(note).cast("string").alias("note"), self._now().alias("created_at"))
        head = settled(head, "run")
        self.store.append("runs", head)
        return head

    def run_items(self, run_id: int) -> DataFrame:
        """case_id, query_text, hit, recall, mrr, latency_ms and retrieved_chunk_ids of a run's cases."""
        return self.store.read("run_items").where(F.col("run_id") == run_id).orderBy("case_id")

    @_operation
    def runs(self, limit: int = 20) -> DataFrame:
        return in_order_of(self.store.read("runs", RUN), "run_id", _within(limit, LISTED, "limit"))

    @_operation
    def freeze(self, label: str, doc_ids: list[str] | None = None, note: str | None = None, pipeline_version: str | None = None) -> int:
        try:
            return self.store.freeze(_named(label, "label", LABEL_LENGTH), of_documents(self._chunks(), _ids(doc_ids, "doc_ids")), self._now(), note, pipeline_version)
        except NoChunks as e:
            raise ServiceError("no_freeze", str(e)) from e
        except DuplicateLabel as e:
            raise ServiceError("label", f"label {e} is taken") from e

    @_operation
    def freezes(self, limit: int = 20) -> DataFrame:
        return in_order_of(self.store.read("freezes", FREEZE), "freeze_id", _within(limit, LISTED, "limit"))

    @_operation
    def freeze_detail(self, freeze_id: int) -> tuple[DataFrame, DataFrame]:
        """A snapshot's head and its first items."""
        head = self.store.read("freezes", FREEZE).where(F.col("freeze_id") == freeze_id)
        if not head.limit(1).count():
            raise ServiceError("no_such_freeze", f"no snapshot {freeze_id}")
        return head, preview(self.store.read("freeze_items").where(F.col("freeze_id") == freeze_id))
