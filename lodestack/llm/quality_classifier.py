"""Quality classifier: gradient-boosted trees, grown on histograms of document statistics.

Trees are complete, so that each is three flat arrays (statistic, threshold, leaf); a batch of documents goes down all of
them by numpy indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import others, quoted
from lodestack.llm.shingles import AT_ONCE, word_hashes

#: Labelled documents that are learned from at most: those whose hashed ids are smallest.
LABELLED = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH, LEAST_WEIGHT = 60, 4, 64, 0.2, 1.0, 1.0
#: A score from which on a document counts as good, and the fold that is held out of five.
THRESHOLD, FOLDS, HELD_OUT = 0.3, 5, 0

STATISTICS = ["bytes", "words", "word_bytes", "word_spread", "upper", "digits", "high", "symbols", "calls", "stops", "bars", "lines", "distinct", "top_word", "pairs"]


def _counts(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags)])[ends]
    return np.diff(np.concatenate([[0], upto])).astype(np.float64)


def _table(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members.encode())] = True
    return out


_CLASSES = {
    "upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _table("0123456789"), "high": np.arange(256) > 127, "symbols": _table("#*$%&<>{}[]\\^~=+@_/"),
    "calls": _table("!?"), "stops": _table(".,;:"), "bars": _table("|"), "lines": _table("\n"),
}


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; null counts as empty, whose shares are 0."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, at = [np.zeros((0, len(STATISTICS)))], 0
    while at < len(texts):
        to = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1))
        raw, ends = data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        hashes, size, many = word_hashes(raw, ends)
        word_ends = np.cumsum(many)
        size_sum = np.diff(np.concatenate([[0], np.concatenate([[0.0], np.cumsum(size)])[word_ends]]))
        square = np.diff(np.concatenate([[0], np.concatenate([[0.0], np.cumsum(size.astype(np.float64) ** 2)])[word_ends]]))
        n, length = np.maximum(many, 1), np.maximum(np.diff(np.concatenate([[0], ends])), 1)
        mean = size_sum / n
        distinct, top, pairs = (np.zeros(len(many)) for _ in range(3))
        for k, (e, m) in enumerate(zip(word_ends.tolist(), many.tolist(), strict=True)):
            if m:
                own = hashes[e - m : e]
                found, often = np.unique(own, return_counts=True)
                distinct[k], top[k] = len(found) / m, often.max() / m
                pairs[k] = len(np.unique(own[1:] * np.uint64(3) + own[:-1])) / max(1, m - 1)
        shares = [_counts(t[raw], ends) / (length if k in ("upper", "digits", "high") else n) for k, t in _CLASSES.items()]
        out.append(np.stack([length, many, mean, np.sqrt(np.maximum(0.0, square / n - mean**2)), *shares, distinct, top, pairs], axis=1))
        at = to
    return np.concatenate(out)


@dataclass
class Trees:
    """``feature`` and ``threshold`` have a row of inner nodes for each tree, ``leaf`` of its leaves; a node's children are 2k+1 and 2k+2."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        """Boosts the logistic loss. Without rows of both kinds the score is the share of good ones, smoothed."""
        p = (y.sum() + 0.5) / (len(y) + 1)
        start, inner = float(np.log(p / (1 - p))), (1 << DEPTH) - 1
        feature, threshold, leaf = [], [], []
        if 0 < y.sum() < len(y):
            cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
            binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
            places = binned + np.arange(x.shape[1]) * BINS
            total = np.full(len(y), start)
            for _ in range(TREES):
                p = 1 / (1 + np.exp(-total))
                f, t, v, step = _grown(binned, places, p - y, p * (1 - p), cuts, inner)
                total += step
                feature.append(f)
                threshold.append(t)
                leaf.append(v)
        return cls(start, np.array(feature, np.int64).reshape(-1, inner), np.array(threshold).reshape(-1, inner), np.array(leaf).reshape(-1, inner + 1))


def _grown(binned, places, g, h, cuts, inner: int):
    """One tree, level by level: a node's split gains most over its histogram; a node without gain sends all to the left."""
    features, width = binned.shape[1], binned.shape[1] * BINS
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node, base, rows = np.zeros(len(g), np.int64), 0, np.arange(len(g))
    for level in range(DEPTH):
        many = 1 << level
        at = (node[:, None] * width + places).ravel()
        gs, hs = (np.bincount(at, np.repeat(w, features), many * width).reshape(many, features, BINS).cumsum(2) for w in (g, h))
        gl, hl, ga, ha = gs[..., :-1], hs[..., :-1], gs[..., -1:], hs[..., -1:]
        gain = gl**2 / (hl + SMOOTH) + (ga - gl) ** 2 / (ha - hl + SMOOTH) - ga**2 / (ha + SMOOTH)
        gain[(hl < LEAST_WEIGHT) | (ha - hl < LEAST_WEIGHT)] = 0
        best = gain.reshape(many, -1).argmax(1)
        f, b = best // (BINS - 1), best % (BINS - 1)
        none = gain.reshape(many, -1).max(1) <= 1e-9
        b[none] = BINS
        feature[base : base + many] = f
        threshold[base : base + many] = [np.inf if n else cuts[i][min(j, len(cuts[i]) - 1)] for i, j, n in zip(f, b, none, strict=True)]
        node = 2 * node + (binned[rows, f[node]] > b[node])
        base += many
    value = -RATE * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + SMOOTH)
    return feature, threshold, value, value[node]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text falls into the fold that nothing is learned from; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """Learns ``quality`` (0 or 1; others and nulls are left out, of repeated rows the lower counts) of labelled documents outside the held-out fold.

    Of an id with several texts that which sorts first counts. Their statistics are worked out by Spark; the ``LABELLED``
    rows at most that the trees see are what the driver holds.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).cast(pa.int32())], ["x", "y"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    # A row for each labelled id, put in order here, so that the trees don't hang on how rows arrive.
    rows = sorted(texts.select("text", "quality").mapInArrow(measured, "x binary, y int").collect(), key=lambda r: (bytes(r["x"]), r["y"]))
    x = np.frombuffer(b"".join(r["x"] for r in rows)).reshape(len(rows), len(STATISTICS))
    return Trees.fit(x, np.array([r["y"] for r in rows], np.float64))


def classify(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``held_out``, ``score`` (0 to 1, higher: good is likelier) and ``predicted``.

    Null texts score as empty ones. Own columns with these names are replaced. Rows stay where they are.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(trees.score(statistics(texts)))

    kept = others(docs, ["held_out", "score", "predicted"])
    told = docs.select(*quoted(kept), held_out(F.col("doc_id")).alias("held_out"), score(F.col(text)).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
