"""Near-duplicate embeddings by product quantisation.

Coarse centroids deal unit vectors into inverted lists; residuals are coded by subspace. A label's vectors are dealt into
as many lists as their number asks for: there is a quantiser for each power of two of lists, and a label takes the one of
its size. A vector probes every list in which a vector within the threshold's distance can lie, holds its distances to the
codes, looked up by subspace, against what the codes' own errors allow, and only what is left is compared by exact cosine.
The bounds are exact, so no link is lost; the sample that centroids and codebooks are fitted on decides the cost alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import components, parts_for, sized_broadcast, stored

#: Vectors that centroids and codebooks are fitted on at most: those whose hashes are smallest.
SAMPLE = 20_000
#: Vectors for each list of a label, lists at most, list entries that one piece of work holds, subspaces and their codes.
FOR_A_LIST, MOST_LISTS, BLOCK, SUBSPACES, CODES = 2_000, 1_024, 4_096, 8, 64
#: Rows of label or list sizes that are broadcast at most, and rows of a part of the work.
SIZES_SENT, IN_A_PART = 100_000, 200_000
TOLERANCE = 1e-6


def _fitted(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from spread-out rows of x; as many centroids as there are different rows, if fewer."""
    rows = np.unique(x, axis=0)
    k = max(1, min(k, len(rows)))
    centroids = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centroids)
        many = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids[many > 0] = sums[many > 0] / many[many > 0][:, None]
    return centroids


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T)


def _nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 4096], y).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Quantiser:
    """Coarse centroids, and a codebook for each subspace of the residuals."""

    centroids: np.ndarray
    cuts: list[np.ndarray]
    books: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Quantiser:
        centroids = _fitted(x, lists)
        residual = x - centroids[_nearest(x, centroids)]
        cuts = [c for c in np.array_split(np.arange(x.shape[1]), SUBSPACES) if len(c)]
        return cls(centroids, cuts, [_fitted(residual[:, c], CODES) for c in cuts])

    def coded(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """Each vector's list, codes, error, and the lists from its own on that may hold vectors within ``radius``.

        A vector nearer to centroid c than to its own, within the radius, lies beyond the plane between the two: so the
        plane is no further off than the radius.
        """
        square = _squares(x, self.centroids)
        cell = square.argmin(1)
        residual = x - self.centroids[cell]
        codes = np.stack([_nearest(residual[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        error = np.sqrt(sum(((residual[:, c] - b[codes[:, m]]) ** 2).sum(1) for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True))))
        apart = np.sqrt(_squares(self.centroids, self.centroids))[cell]
        own = square[np.arange(len(x)), cell][:, None]
        near = (square - own <= 2 * (radius + TOLERANCE) * apart + TOLERANCE) | (np.arange(len(self.centroids))[None] == cell[:, None])
        near &= np.arange(len(self.centroids))[None] >= cell[:, None]
        return cell, codes, error, [np.flatnonzero(r).tolist() for r in near]

    def lower_bounds(self, x: np.ndarray, cell: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of ``x`` to the coded vectors of a list."""
        residual, square = x - self.centroids[cell], np.zeros((len(x), len(codes)))
        for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            square += _squares(residual[:, c], b)[:, codes[:, m]]
        return np.sqrt(square) - error[None]


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / top
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a bipartite graph the least column that it hangs together with; len(columns) if none."""
    none = linked.shape[1]
    column = np.where(linked.any(0), np.arange(none), none)
    while True:
        row = np.where(linked, column[None], none).min(1, initial=none)
        fresh = np.minimum(column, np.where(linked, row[:, None], none).min(0, initial=none))
        if (fresh == column).all():
            return row, column
        column = fresh


def _links(rows: DataFrame, quantisers: list[Quantiser], cosine: float, dtype: str) -> DataFrame:
    """Rows (id, other, links): partial sums of links, and edges enough to tell what hangs together."""
    radius = math.sqrt(2 - 2 * cosine)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_of = None
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            label, level, cell, block, query, own, ids, n, error = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "level", "cell", "block", "query", "own", "id", "n", "error"))
            if not len(ids):
                continue
            x = unit(np.frombuffer(b"".join(batch.column("vector").to_pylist()), dtype).reshape(len(ids), -1))
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            cuts = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])]))
            found = []
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True):
                this = (label[s], cell[s], block[s])
                if this != unit_of:
                    unit_of, held = this, {}
                if not query[s]:
                    mine = {"x": x[s:e], "ids": ids[s:e], "n": n[s:e], "codes": codes[s:e], "error": error[s:e]}
                    held = {k: np.concatenate([held[k], v]) for k, v in mine.items()} if held else mine
                    continue
                if not held:
                    continue
                for at in range(s, e, 512):
                    q = slice(at, min(e, at + 512))
                    near = quantisers[level[s]].lower_bounds(x[q], int(cell[s]), held["codes"], held["error"]) <= radius + TOLERANCE
                    # A pair of one list would meet twice; of two lists only the first one's vectors are queries.
                    near &= ~own[q][:, None] | (ids[q][:, None] < held["ids"][None])
                    i, j = np.nonzero(near)
                    good = np.einsum("ij,ij->i", x[q][i], held["x"][j]) >= cosine
                    i, j = i[good], j[good]
                    if not len(i):
                        continue
                    linked = np.zeros(near.shape, bool)
                    linked[i, j] = True
                    row, column = _spanning(linked)
                    a, b = np.unique(i), np.unique(j)
                    found.append((ids[q][a], held["ids"][row[a]], linked[a] @ held["n"]))
                    found.append((held["ids"][b], held["ids"][column[b]], linked[:, b].T @ n[q]))
            if found:
                out = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], ["id", "other", "links"])

    return rows.mapInArrow(compared, "id long, other long, links long")


def _indexed(vectors: DataFrame, quantisers: list[Quantiser], cosine: float, dtype: str) -> DataFrame:
    """``vectors`` (id, label, n, level, vector) with their list, codes, error and the lists that they probe."""
    radius = math.sqrt(2 - 2 * cosine)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = batch.column("level").to_numpy()
            for level in np.unique(levels):
                rows = batch.take(pa.array(np.flatnonzero(levels == level)))
                x = unit(np.frombuffer(b"".join(rows.column("vector").to_pylist()), dtype).reshape(rows.num_rows, -1))
                cell, codes, error, probes = quantisers[level].coded(x, radius)
                more = [pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "cell", "code", "error", "probes"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(indexed, f"{columns}, cell int, code binary, error double, probes array<int>")


def link(table: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``table``; other columns are left out.

    Vectors link if their labels and dimensions are equal and their cosine, in double precision, is ``cosine`` at least. ``n_links``
    counts other vectors linked directly, ``component_id`` is the smallest vec_id reachable by links, and ``kept`` tells that it is the
    vector's own. Vectors that are null, empty, zero or hold null or non-finite components, and those without label or
    vec_id, link with nothing; without vec_id the component is null and the row is kept. Repeated rows are vectors each.

    Equal vectors are one with a count. The driver holds the sample, which is bounded; the rest stays distributed.
    """
    v = F.col("embedding")
    double = dict(table.dtypes)[embedding] == "array<double>"
    real, dtype = ("double", "<f8") if double else ("float", "<f4")
    whole = dict(table.dtypes)[label] in ("tinyint", "smallint", "int", "bigint")
    label_key = F.when(F.col(label).isNotNull(), F.col(label).cast("long") if whole else F.xxhash64(label))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{real}>").alias("embedding"), label_key.alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")).cast(real)))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one number, so equal vectors have one hash.
    rows = rows.withColumn("good", good).withColumn("id", F.when(F.col("good"), F.xxhash64("label", F.transform(v, lambda x: x + F.lit(0.0).cast(real)))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
            sizes = np.diff(np.concatenate([[0], ends]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sizes.astype(np.int32)), pa.array([flat[e - k : e].tobytes() for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())], ["id", "label", "n", "dim", "vector"])

    distinct = rows.where("good").groupBy("id").agg(F.first("embedding").alias("embedding"), F.first("label").alias("label"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
    distinct = stored(distinct, "distinct-vectors")
    vectors = stored(distinct.select("id", "embedding", "label", "n").mapInArrow(packed, "id long, label long, n long, dim int, vector binary"), "vectors")
    found = None
    for dim, many in sorted((r["dim"], r["count"]) for r in vectors.groupBy("dim").count().collect()):
        own = vectors.where(F.col("dim") == dim).drop("dim")
        sample = own.orderBy(F.xxhash64("id"), "id").select("vector").limit(SAMPLE).collect()
        x = unit(np.frombuffer(b"".join(r[0] for r in sample), dtype).reshape(len(sample), dim))
        # A label of m vectors takes the quantiser of 2 ** level lists, the power of two next to its number of lists.
        level = F.least(F.floor(F.log2(1 + F.col("count") / FOR_A_LIST) + 0.5), F.lit(int(math.log2(MOST_LISTS)))).cast("int")
        levels = stored(own.groupBy("label").count().select("label", level.alias("level")), "label-levels")
        top = levels.agg(F.max("level"), F.count(F.lit(1))).first()
        quantisers = [Quantiser.fit(x, 1 << k) for k in range(top[0] + 1)]
        indexed = stored(_indexed(own.join(sized_broadcast(levels, top[1], SIZES_SENT), "label"), quantisers, cosine, dtype), "indexed-vectors")
        sizes = stored(indexed.groupBy("label", "cell").count().select("label", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "list-sizes")
        sizes = sized_broadcast(sizes, sizes.count(), SIZES_SENT)
        common = ["label", "level", "cell", "block", "query", "own", "id", "n", "vector", "code", "error"]
        entries = indexed.drop("probes").join(sizes, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        entries = entries.withColumns({"query": F.lit(False), "own": F.lit(True)}).select(*common)
        asked = indexed.withColumn("probe", F.explode("probes")).withColumn("own", F.col("cell") == F.col("probe")).drop("cell", "probes").withColumnRenamed("probe", "cell")
        asked = asked.join(sizes, ["label", "cell"])
        parts = parts_for(table.sparkSession, many + (asked.agg(F.sum("blocks")).first()[0] or 0), IN_A_PART)
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(True)).select(*common)
        work = entries.unionByName(asked).repartition(parts, "label", "cell", "block").sortWithinPartitions("label", "cell", "block", "query", "id")
        links = stored(_links(work, quantisers, cosine, dtype), "vector-links")
        found = links if found is None else found.unionByName(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    joined = components(found.select(F.col("id").alias("src"), F.col("other").alias("dst")))
    of = distinct.select("id", "n", "low").join(joined, F.col("id") == F.col("node"), "left").join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
    of = stored(of.select("id", "n", "low", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "vector-components")
    lows = stored(of.groupBy("component").agg(F.min("low").alias("component_id")), "component-lows")
    of = stored(of.join(lows, "component").select("id", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id"), "linked-vectors")
    some = rows.where("good").select("vec_id", "id").join(of, "id").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return some.unionByName(rest)
