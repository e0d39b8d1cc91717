"""Retrieval for batches of query vectors: similarity, over-fetch, filters, threshold, cut, and what is told of each query."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.sources.shared import settled

#: How many times the wanted rows are fetched before filters, queries that a scan of the index takes along, and scores held at once.
OVER_FETCH = 3
QUERIES_AT_ONCE, SCORES_AT_ONCE = 32_768, 4_000_000
#: What single precision may make of a cosine, at most, and found rows that leave a task at once.
ROUNDED, ROWS_AT_ONCE = 1e-5, 10_000


def _first(k: np.ndarray, ids: pa.Array, score: np.ndarray, n: int) -> np.ndarray:
    """Places of each query's first ``n`` rows by score, equal ones by id; ``k`` tells the row's query."""
    order = pc.sort_indices(pa.table({"k": k, "score": score, "id": ids}), sort_keys=[("k", "ascending"), ("score", "descending"), ("id", "ascending")]).to_numpy()
    k = k[order]
    return order[np.arange(len(k)) - np.searchsorted(k, k) < n]


def _unlike(x: np.ndarray, ids: pa.Array, n: int) -> np.ndarray:
    """Places of the rows of ``x`` of which fewer than ``n`` equal ones have a smaller id: no others are among anyone's first ``n``."""
    rows = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.itemsize * x.shape[1])))[:, 0]
    _, kind = np.unique(rows, return_inverse=True)
    return np.sort(_first(kind, ids, np.zeros(len(x)), n))


class _Asked:
    """A block of queries as a task holds them."""

    def __init__(self, queries: list):
        self.ids, self.skip = [q["query_id"] for q in queries], [q["exclude"] for q in queries]
        self.vectors = np.array([q["vector"] for q in queries], np.float64)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))


class _Nearest:
    """The best ``n`` rows for each query of a block among those that a task has seen.

    Held are as many rows as that twice over. Scores in single precision are compared in bulk with each query's least one so far,
    less what rounding may make of them; those that may reach it are worked out in double precision.
    """

    def __init__(self, asked: _Asked, n: int):
        self.asked, self.n, self.most = asked, n, max(100_000, 2 * n * len(asked.ids))
        self.least = np.full(len(asked.ids), -np.inf)
        self.held, self.many = [], 0
        self.excluding = any(c is not None for c in asked.skip)

    def see(self, batch: pa.RecordBatch, some: np.ndarray | None = None) -> None:
        """Takes up a batch (chunk_id, vector) for each query, or for ``some``."""
        size, asked = self.asked.vectors.shape[1], self.asked
        good = np.array([v is not None and v == size for v in batch.column(1).value_lengths().to_pylist()], bool)
        rows, numbers = batch.filter(pa.array(good)), np.arange(len(asked.ids)) if some is None else some
        if not rows.num_rows or not len(numbers):
            return
        x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
        with np.errstate(invalid="ignore", over="ignore"):
            norms = np.sqrt((x * x).sum(1))
        usable = np.flatnonzero(np.isfinite(norms) & (norms > 0))
        usable = usable[_unlike(x[usable], rows.column(0).take(pa.array(usable)), self.n + 1)]  # one more, as one may be excluded
        if not len(usable):
            return
        x, norms, ids = x[usable], norms[usable], rows.column(0).take(pa.array(usable))
        places = {c: i for i, c in enumerate(ids.to_pylist())} if self.excluding else {}
        unit, step = np.ascontiguousarray((x / norms[:, None]).T, np.float32), max(1, SCORES_AT_ONCE // len(x))
        for a in range(0, len(numbers), step):
            self._take(numbers[a : a + step], x, unit, norms, ids, places)

    def _take(self, own: np.ndarray, x: np.ndarray, unit: np.ndarray, norms: np.ndarray, ids: pa.Array, places: dict) -> None:
        asked, n = self.asked, self.n
        with np.errstate(invalid="ignore", divide="ignore"):
            score = (asked.vectors[own] / asked.norms[own, None]).astype(np.float32) @ unit
        out = [(i, places[asked.skip[k]]) for i, k in enumerate(own) if asked.skip[k] in places] if places else []
        if out:
            score[tuple(zip(*out, strict=True))] = -np.inf
        if score.shape[1] > n and not np.isfinite(self.least[own]).all():
            self.least[own] = np.fmax(self.least[own], np.partition(score, -n, axis=1)[:, -n] - ROUNDED)
        i, at = np.divmod(np.flatnonzero(score >= (self.least[own] - ROUNDED)[:, None].astype(np.float32)), score.shape[1])
        k = own[i]
        exact = np.einsum("ij,ij->i", asked.vectors[k], x[at]) / (asked.norms[k] * norms[at])
        kept = np.flatnonzero(np.isfinite(exact) & (score[i, at] > -np.inf))
        self.held.append((k[kept], ids.take(pa.array(at[kept])), exact[kept]))
        self.many += len(kept)
        if self.many > self.most:
            self._cut()

    def _cut(self) -> None:
        k, score = (np.concatenate([h[j] for h in self.held]) for j in (0, 2))
        ids = pa.concat_arrays([h[1] for h in self.held])
        first = _first(k, ids, score, self.n)
        k, ids, score = k[first], ids.take(pa.array(first)), score[first]
        full = np.flatnonzero(np.arange(len(k)) - np.searchsorted(k, k) == self.n - 1)
        self.least[k[full]] = np.fmax(self.least[k[full]], score[full])
        self.held, self.many = [(k, ids, score)], len(k)

    def found(self) -> Iterator[pa.RecordBatch]:
        if not self.many:
            return
        self._cut()
        (k, ids, score), query_ids = self.held[0], pa.array(self.asked.ids)
        for a in range(0, len(k), ROWS_AT_ONCE):
            b = slice(a, a + ROWS_AT_ONCE)
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(k[b])), ids[b], pa.array(score[b])], ["query_id", "chunk_id", "score"])


def _shape(index: DataFrame, id_type: str) -> str:
    return f"query_id {id_type}, chunk_id {dict(index.dtypes)['chunk_id']}, score double"


def _scored(index: DataFrame, queries: list, n: int, id_type: str) -> DataFrame:
    asked = _Asked(queries)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Nearest(asked, n)
        for batch in batches:
            own.see(batch)
        yield from own.found()

    return index.select("chunk_id", "vector").mapInArrow(scored, _shape(index, id_type))


def scored_pairs(index: DataFrame, queries: list, wanted: np.ndarray, parts: list[int], n: int, id_type: str) -> DataFrame:
    """As a scan of all of ``index`` (chunk_id, vector, ring), but a query meets only the rings that ``wanted`` has for it, a row for
    each query and a column for each of ``parts``; rings that no query wants aren't read."""
    asked, of = _Asked(queries), {p: np.flatnonzero(wanted[:, j]) for j, p in enumerate(parts) if wanted[:, j].any()}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Nearest(asked, n)
        for batch in batches:
            rings = batch.column(2).to_numpy(zero_copy_only=False)
            for ring in np.unique(rings).tolist():
                own.see(batch.filter(pa.array(rings == ring)), of[ring])
        yield from own.found()

    return index.where(F.col("ring").isin(list(of))).select("chunk_id", "vector", "ring").mapInArrow(scored, _shape(index, id_type))


def candidates(queries: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of ``index`` (chunk_id, vector) nearest to each of ``queries`` (query_id, vector; optionally exclude, a chunk_id).

    Columns query_id, chunk_id, score (cosine) and rank from 1; ties stand by chunk_id. Queries are the stated set: they go to
    the tasks in blocks of ``QUERIES_AT_ONCE`` of one length. If there are several blocks, one's result is stored before the
    next is read, so the driver holds one block at most. Vectors that are null, zero or of another length are in no result.
    Ids of queries must be unique; it is an error if they aren't.
    """
    id_type, chunk_type = dict(queries.dtypes)["query_id"], dict(index.dtypes)["chunk_id"]
    stated = queries.select("query_id", "vector", queries["exclude"] if "exclude" in queries.columns else F.lit(None).cast(chunk_type).alias("exclude")).where("size(vector) > 0")
    stated = settled(stated, "stated-queries")  # vectors are worked out once
    if stated.groupBy("query_id").count().where("count > 1").limit(1).count():
        raise ValueError("queries must have ids of their own")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    lots = sorted(map(tuple, stated.groupBy(F.size("vector")).count().collect()))  # as many rows as vectors have lengths
    work = [(size, b, -(-many // QUERIES_AT_ONCE)) for size, many in lots for b in range(-(-many // QUERIES_AT_ONCE))]
    found = None
    for size, b, blocks in work:
        block = stated.where((F.size("vector") == size) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
        if block:
            part = ranked(_scored(index, block, n, id_type))
            part = settled(part, "nearest") if len(work) > 1 else part
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = ranked(index.select(F.lit(None).cast(id_type).alias("query_id"), "chunk_id", F.lit(0.0).alias("score")).limit(0))
    return found


def fetched(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``OVER_FETCH`` * k rows of ``index`` by similarity for each query; its columns but the vector come along."""
    return candidates(queries, index, OVER_FETCH * k).join(index.drop("vector"), "chunk_id")


ANY = "map<string,variant>"


def values_of(columns: list[str]) -> Column:
    """What filters may ask for, by name: the ``columns``, and under other names the keys of the JSON object in a column ``metadata``."""
    named = [c for c in columns if c not in ("vector", "metadata")]
    own = F.coalesce(F.try_variant_get(F.parse_json(F.to_json(F.struct(*named))), "$", ANY), F.create_map().cast(ANY))
    if "metadata" not in columns:
        return own
    more = F.coalesce(F.try_variant_get(F.try_parse_json("metadata"), "$", ANY), F.create_map().cast(ANY))
    return F.map_concat(F.map_filter(more, lambda k, _: ~k.isin(named)), own)


def _same(a: Column, b: Column) -> Column:
    """Whether two values are equal: numbers and truth values by number, lists as a whole, nothing like null."""
    kind = F.schema_of_variant
    number = lambda x: F.when(kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("int").cast("double")).when(kind(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(x, "$", "double"))
    none = lambda x: x.isNull() | F.is_variant_null(x)
    both = F.when(number(a).isNotNull() & number(b).isNotNull(), number(a) == number(b)).otherwise(F.to_json(a) == F.to_json(b))
    return F.when(none(a) | none(b), none(a) & none(b)).otherwise(both)


def fits(filters: Column, values: Column) -> Column:
    """Whether every named value of the map ``filters`` is that of the map ``values``; a missing one equals null, no filter fits all."""
    return F.coalesce(F.forall(F.map_entries(filters), lambda e: _same(e["value"], F.try_element_at(values, e["key"]))), F.lit(True))


def filters_of(told: Column) -> Column:
    """A filter written as a JSON object; null without one."""
    return F.try_variant_get(F.try_parse_json(told), "$", ANY)


NUMBERS = ("tinyint", "smallint", "int", "bigint")


def _plain(name: str, kind: str, value: object) -> Column | None:
    """``fits`` for one column of a plain type, as a comparison that a scan can take over; None for other types."""
    c = F.col(f"`{name}`")
    if kind not in (*NUMBERS, "float", "double", "boolean", "string"):
        return None
    if value is None:
        return c.isNull()
    if isinstance(value, (list, dict)) or isinstance(value, str) != (kind == "string"):
        return F.lit(False)
    if kind == "string":
        same = c == value
    elif kind == "boolean":
        same = c.cast("int").cast("double") == float(value)
    else:
        same = c == F.lit(int(value)).cast("bigint") if kind in NUMBERS and float(value).is_integer() and abs(value) < 1 << 53 else c.cast("double") == float(value)
    return F.coalesce(same, F.lit(False)) if kind == "boolean" else same & c.isNotNull()


def matches(filters: dict[str, object], columns: list[str] | list[tuple[str, str]]) -> Column | None:
    """Whether a row with these ``columns`` fits ``filters`` (see ``values_of`` and ``fits``); None without filters.

    ``columns`` can be names, or names with types (``dtypes``): what is asked of a column of a plain type is then compared as
    it is, and only other names go through the row's values.
    """
    types = {c[0]: c[1] for c in columns if not isinstance(c, str)}
    names = [c if isinstance(c, str) else c[0] for c in columns]
    direct = {k: _plain(k, types[k], v) for k, v in filters.items() if k in types and k not in ("vector", "metadata")}
    conditions = [c for c in direct.values() if c is not None]
    rest = {k: v for k, v in filters.items() if direct.get(k) is None}
    if rest:
        conditions.append(fits(filters_of(F.lit(json.dumps(rest))), values_of(names)))
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def present(*columns: str) -> Column:
    """Whether none of the columns is null or blank."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return out


def filtered(fetched: DataFrame, condition: Column, min_score: float | None, k: int | Column) -> DataFrame:
    """Of each query's fetched rows those that fit, reach ``min_score`` and are the first ``k`` then; ``rank`` is counted anew.

    The condition comes after the fetch: a query may get fewer than ``k`` rows although more rows of the index fit.
    """
    rows = fetched.where(condition)
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)


def retrieve(queries: DataFrame, index: DataFrame, k: int, condition: Column | None = None, min_score: float | None = None) -> DataFrame:
    """Ranked rows of ``index`` for each query: over-fetch by similarity, then condition, threshold and cut.

    ``index`` has chunk_id, vector and whatever the condition and the reader need.
    """
    return filtered(fetched(queries, index, k), F.lit(True) if condition is None else condition, min_score, k)


def traced(queries: DataFrame, rows: DataFrame, k: int, condition: Column | None = None, min_score: float | None = None) -> DataFrame:
    """A row for each query and its fetched ``rows``: how many were fetched and returned, their scores' max, min and mean, and the best score before the threshold."""
    fit = F.lit(True) if condition is None else condition
    before = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved_before_filter"), F.max(F.when(fit, F.col("score"))).alias("top_before_threshold"))
    after = filtered(rows, fit, min_score, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved_after_filter"), F.max("score").alias("max_score"), F.min("score").alias("min_score_value"), F.avg("score").alias("avg_score"))
    told = queries.select("query_id").join(before, "query_id", "left").join(after, "query_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return told.select(
        "query_id", count("retrieved_before_filter"), count("retrieved_after_filter"), (F.coalesce("retrieved_after_filter", F.lit(0)) == 0).alias("is_empty_recall"),
        F.coalesce("max_score", "top_before_threshold").alias("top_score"), "min_score_value", "avg_score",
    )


def trace(queries: DataFrame, index: DataFrame, k: int, condition: Column | None = None, min_score: float | None = None) -> DataFrame:
    """``traced`` of the rows of ``index`` that the queries fetch; these are stored, as they are needed twice."""
    return traced(queries, settled(fetched(queries, index, k), "fetched"), k, condition, min_score)
