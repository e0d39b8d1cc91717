"""Exact nearest neighbours by pivots: parts of the index that the triangle inequality rules out are never read.

Unit vectors lie in cells around pivots, a cell cut into rings by distance from its pivot; a ring is a partition of the
stored index and knows its least and greatest distance. A query reads its nearest rings first. What lies in a ring is no
nearer to it than the difference between its own distance from the pivot and the ring's, so rings further off than its
n-th best are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.retrieval import QUERIES_AT_ONCE, scored_pairs
from lodestack.sources.shared import own_dir, settled

#: Rows of a ring, about; pivots at most, which tasks hold; what distances may err by.
IN_A_RING, MOST_PIVOTS, SLACK = 50_000, 2_048, 1e-6


@dataclass
class Pivoted:
    """``rows`` (chunk_id, vector, ring) partitioned by ring; ``pivots`` are unit vectors; ``rings`` has (ring, pivot, low, high, n)."""

    rows: DataFrame
    pivots: np.ndarray
    rings: list[tuple[int, int, float, float, int]]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def pivoted(index: DataFrame, in_a_ring: int = IN_A_RING) -> Pivoted:
    """``index`` (chunk_id, vector) in cells and rings. Vectors must have one length; null and zero ones are left out.

    Pivots are vectors of the index, drawn by hash: the square root of the number of rings, so that a cell has as many rings
    as there are cells. The driver holds pivots and a row for each ring.
    """
    good = index.select("chunk_id", "vector").where("size(vector) > 0 and exists(vector, x -> x <> 0) and forall(vector, x -> x is not null)")
    many = good.count()
    rings = max(1, -(-many // in_a_ring))
    drawn = good.orderBy(F.xxhash64("vector"), "chunk_id").limit(min(MOST_PIVOTS, max(1, int(rings**0.5)))).select("vector").collect()
    pivots = _unit(np.array([r[0] for r in drawn], np.float64)) if drawn else np.zeros((0, 0))

    @F.arrow_udf("pivot int, distance double")
    def placed(vectors: pa.Array) -> pa.Array:
        x = _unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)) if len(vectors) else np.zeros((0, pivots.shape[1]))
        cosine = x @ pivots.T
        at = cosine.argmax(1) if len(x) else np.zeros(0, np.int64)
        distance = np.sqrt(np.maximum(0.0, 2 - 2 * cosine[np.arange(len(x)), at]))
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(distance)], ["pivot", "distance"])

    placed_rows = settled(good.select("chunk_id", "vector", placed("vector").alias("p")).select("chunk_id", "vector", "p.pivot", "p.distance"), "pivot-distances")
    # Ranges by pivot and distance: as many as rings, each one part of the stored table.
    ringed = placed_rows.repartitionByRange(rings, "pivot", "distance").withColumn("ring", F.spark_partition_id() * F.lit(MOST_PIVOTS) + F.col("pivot"))
    path = f"{own_dir(index.sparkSession)}/pivots-{uuid.uuid4().hex}"
    ringed.write.partitionBy("ring").mode("overwrite").parquet(path)
    rows = index.sparkSession.read.schema(ringed.schema).parquet(path)
    told = rows.groupBy("ring").agg(F.first("pivot"), F.min("distance"), F.max("distance"), F.count(F.lit(1))).collect()
    return Pivoted(rows.select("chunk_id", "vector", "ring"), pivots, sorted(map(tuple, told)))


def _nearest(q: np.ndarray, index: Pivoted) -> np.ndarray:
    """How near to each query (rows) a vector of each ring can be at the least."""
    own = np.sqrt(np.maximum(0.0, 2 - 2 * (q @ index.pivots.T)))[:, [r[1] for r in index.rings]]
    low, high = (np.array([r[k] for r in index.rings]) for k in (2, 3))
    return np.maximum(0.0, np.maximum(own - high, low - own) - SLACK)


def nearest(queries: DataFrame, index: Pivoted, n: int) -> tuple[DataFrame, float]:
    """The ``n`` rows of the index nearest to each of ``queries`` (query_id, vector; optionally exclude), as ``retrieval.candidates`` gives
    them, and the share of the pairs of queries and rows that were looked at.

    Queries are the stated set, unique by id and of the index's length; they go to the tasks in blocks. A block reads its
    queries' first rings, then in one more pass those that can still hold something better.
    """
    id_type, chunk_type = dict(queries.dtypes)["query_id"], dict(index.rows.dtypes)["chunk_id"]
    exclude = queries["exclude"] if "exclude" in queries.columns else F.lit(None).cast(chunk_type)
    stated = queries.select("query_id", "vector", exclude.alias("exclude")).where("size(vector) > 0 and exists(vector, x -> x <> 0)")
    many = stated.count()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    blocks, out, looked, total = -(-many // QUERIES_AT_ONCE), None, 0, many * sum(r[4] for r in index.rings)
    for b in range(blocks if index.rings else 0):
        block = stated.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not block:
            continue
        q = _unit(np.array([r["vector"] for r in block], np.float64))
        near, sizes = _nearest(q, index), np.array([r[4] for r in index.rings])
        order = np.argsort(near, axis=1, kind="stable")
        # First as many of the nearest rings as hold n rows and the excluded one.
        upto = np.cumsum(sizes[order], axis=1)
        first = np.zeros(near.shape, bool)
        np.put_along_axis(first, order, (upto - sizes[order]) <= n, axis=1)
        found = settled(ranked(scored_pairs(index.rows, block, first, [r[0] for r in index.rings], n, id_type)), "first-rings")
        worst = dict(map(tuple, found.groupBy("query_id").agg(F.min("score"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= n).select("query_id", "min(score)").collect()))
        bound = np.array([np.sqrt(max(0.0, 2 - 2 * worst[r["query_id"]])) + SLACK if r["query_id"] in worst else np.inf for r in block])
        more = ~first & (near <= bound[:, None])
        looked += int((first * sizes).sum() + (more * sizes).sum())
        if more.any():
            found = settled(ranked(found.drop("rank").unionByName(scored_pairs(index.rows, block, more, [r[0] for r in index.rings], n, id_type))), "further-rings")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = ranked(index.rows.select(F.lit(None).cast(id_type).alias("query_id"), "chunk_id", F.lit(0.0).alias("score")).limit(0))
    return out, looked / total if total else 0.0
