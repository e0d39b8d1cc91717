"""Importance resampling towards a target: hashed n-gram features, weights by array look-up, an exact draw of the best scores.

A feature is a run of one to three words, counted in the bucket of its CRC. A bucket's gain is the logarithm of how much
likelier the target's texts hold it than the corpus; a document's weight is the sum over its features, and its score
adds noise that its id fixes, so that the highest scores are a draw without putting back.

The draw is by merging: rows that may be drawn are cut into key ranges, each partition's rows of a range are sorted into
runs, packed in blocks, and a range's blocks are merged by a tournament tree. Blocks come to the merge in the order of
their first keys, so a block is opened when its first row may be next, and those open at a time are few. Ranges before
tell a range's first rank; the merge stops at the last rank.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import stored
from lodestack.llm.plain_words import stretches

#: Longest run of words, buckets, the seed of the noise, and which of how many hundredths are drawn of documents with so many words.
RUN_WORDS, BUCKETS, SEED, PERCENT, LEAST_WORDS = 3, 10_000, 42, 5, 20
#: Rows of a key range, about, rows of its sample for each range, rows that are sorted at once, and rows of a block.
IN_A_RANGE, SAMPLES, AT_ONCE, IN_A_BLOCK = 200_000, 64, 500_000, 2_048
#: A row's place in the order: its score from the highest down, its id (nulls last), features, and its number in the table.
KEY = ["down", "no_id", "id", "n_features", "row"]


def features(raw: bytes) -> Iterator[np.ndarray]:
    """The buckets of a text's features, a bounded stretch of it at a time, each feature where its last word stands."""
    carried: list[bytes] = []
    for fresh in stretches(raw):
        words, old = carried + fresh, len(carried)
        spaced = [b" " + w for w in words]
        crc = list(map(crc32, words))
        out = [crc[old:]]
        for k in range(1, RUN_WORDS):
            # A longer run's CRC goes on from that of the run without its last word.
            crc = list(map(crc32, spaced[k:], crc))
            out.append(crc[max(0, old - k) :])
        yield np.concatenate([np.array(x, np.int64) for x in out]) % BUCKETS
        carried = words[1 - RUN_WORDS :]


def counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n) of the features of all texts, every bucket that has any. Each task counts its texts in an array."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                for own in features(raw.as_py() or b""):
                    total += np.bincount(own, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select(F.col(text).cast("binary")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> np.ndarray:
    """A bucket's gain, floor(1000 * ln((t + 1)(S + B) / ((s + 1)(T + B)))), for each of the B buckets, which are all that the driver holds."""
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for out, rows in ((s, counts(docs, text)), (t, counts(target, target_text))):
        for bucket, n in rows.collect():
            out[bucket] = n
    over, under = int(s.sum()) + BUCKETS, int(t.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log(float((b + 1) * over) / float((a + 1) * under))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def noise(doc_id: Column) -> Column:
    """floor(-1000 * ln(-ln((h + 0.5) / 2**32))), h the first 32 bits of the id's seeded SHA-256; a null id counts as the empty text."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of ``docs``."""

    @F.arrow_udf("n_words bigint, n_features bigint, weight bigint")
    def told(texts: pa.Array) -> pa.Array:
        out = np.zeros((3, len(texts)), np.int64)
        for i, raw in enumerate(texts):
            n = weight = 0
            for own in features(raw.as_py() or b""):
                n += len(own)
                weight += int(gain[own].sum())
            # Of n words there are n runs of one, n - 1 of two and n - 2 of three.
            out[:, i] = n if n < 2 else n // 3 + 1, n, weight
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), told(F.col(text).cast("binary")).alias("t"))
    return rows.select("doc_id", "t.n_words", "t.n_features", "t.weight", (F.col("t.weight") + noise(F.col("doc_id"))).alias("score"))


class Tournament:
    """A tournament tree over open blocks: a leaf holds a block's next key, an inner node the better of the two below it.

    The winner's path alone is played again when it moves on. The tree doubles when there are more blocks than leaves.
    """

    def __init__(self):
        self.leaves, self.tree, self.free = 1, [None, None], [0]

    def _play(self, leaf: int) -> None:
        node = (self.leaves + leaf) >> 1
        while node:
            a, b = self.tree[2 * node], self.tree[2 * node + 1]
            self.tree[node] = b if a is None or (b is not None and b < a) else a
            node >>= 1

    def winner(self):
        """(key, leaf) of the best; None when all blocks are spent."""
        return self.tree[1]

    def enter(self, key: tuple) -> int:
        """A leaf for a block whose first key this is."""
        if not self.free:
            old, n = self.tree[self.leaves :], self.leaves
            self.leaves, self.free = 2 * n, list(range(2 * n - 1, n - 1, -1))
            self.tree = [None] * (2 * n) + old + [None] * n
            for leaf in range(0, n, 2):
                self._play(leaf)
        leaf = self.free.pop()
        self.move(leaf, key)
        return leaf

    def move(self, leaf: int, key: tuple | None) -> None:
        """The next key of a leaf's block; None if it is spent, which frees the leaf."""
        self.tree[self.leaves + leaf] = None if key is None else (key, leaf)
        if key is None:
            self.free.append(leaf)
        self._play(leaf)


def _merged(blocks: Iterator[tuple[tuple, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Rows of sorted blocks, which come by their first keys: pieces (rows, from, to) in order until ``most`` rows, then what is left.

    A piece with a negative end is beyond the draw.
    """
    tree, open_, done = Tournament(), {}, 0
    coming = next(blocks, None)
    while done < most and (coming is not None or open_):
        best = tree.winner()
        if coming is not None and (best is None or coming[0] <= best[0]):
            rows = coming[1]
            open_[tree.enter(tuple(rows[0].tolist()))] = [rows, 0]
            coming = next(blocks, None)
            continue
        leaf = best[1]
        rows, at = held = open_[leaf]
        yield rows, at, at + 1
        done += 1
        held[1] = at + 1
        if at + 1 < len(rows):
            tree.move(leaf, tuple(rows[at + 1].tolist()))
        else:
            del open_[leaf]
            tree.move(leaf, None)
    for rows, at in open_.values():
        yield rows, at, -1
    while coming is not None:
        yield coming[1], 0, -1
        coming = next(blocks, None)


def _packed(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, np.int64).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, len(KEY) + 1)


def _runs(borders: list[tuple]):
    """Sorts the rows of a partition, ``AT_ONCE`` at a time, and packs each key range's run into blocks."""
    names = ["range", *KEY, "block"]

    def packed(x: np.ndarray) -> pa.RecordBatch:
        x = x[np.lexsort(x[:, len(KEY) - 1 :: -1].T)]
        keys = list(map(tuple, x[:, : len(KEY)].tolist()))
        ends = [*(bisect_right(keys, b) for b in borders), len(keys)]
        out: list[list] = [[] for _ in names]
        for r, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            for at in range(a, b, IN_A_BLOCK):
                for column, value in zip(out, (r, *keys[at], _packed(x[at : min(b, at + IN_A_BLOCK)])), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(out[-1], pa.binary())], names)

    def sorted_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
            many += batch.num_rows
            if many >= AT_ONCE:
                yield packed(np.concatenate(held))
                held, many = [], 0
        if many:
            yield packed(np.concatenate(held))

    return sorted_


def _drawn(starts: list[int], draw: int):
    """Merges the blocks of each range in a partition; a row's rank follows from its range's start; none beyond ``draw``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, np.ndarray]]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = _unpacked(batch.column("block")[i].as_py())
                yield batch.column("range")[i].as_py(), tuple(rows[0, : len(KEY)].tolist()), rows

    def told(rows: list[np.ndarray], ranks: list[np.ndarray]) -> pa.RecordBatch:
        x, rank = np.concatenate([np.zeros((0, len(KEY) + 1), np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *ranks])
        ids, score = pa.array(x[:, 2], mask=x[:, 1] > 0), pa.array(-x[:, 0])
        return pa.RecordBatch.from_arrays([ids, pa.array(x[:, 3]), pa.array(x[:, 5]), score, pa.array(rank, mask=rank < 1)], ["doc_id", "n_features", "weight", "score", "rank"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coming = blocks(batches)
        head = next(coming, None)
        while head is not None:
            own = head[0]

            def of_range(own=own) -> Iterator[tuple[tuple, np.ndarray]]:
                nonlocal head
                while head is not None and head[0] == own:
                    yield head[1], head[2]
                    head = next(coming, None)

            rows, ranks, held, rank = [], [], 0, starts[own]
            for x, a, b in _merged(of_range(), draw - starts[own]):
                rows.append(x[a:] if b < 0 else x[a:b])
                if b < 0:
                    ranks.append(np.zeros(len(rows[-1]), np.int64))
                else:
                    ranks.append(np.arange(rank + 1, rank + 1 + b - a))
                    rank += b - a
                held += len(rows[-1])
                if held >= 10_000:
                    yield told(rows, ranks)
                    rows, ranks, held = [], [], 0
            yield told(rows, ranks)

    return merged


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``docs``; the rank is null for what isn't drawn.

    Of the N rows with ``LEAST_WORDS`` words or more, floor(``PERCENT`` * N / 100) are drawn: those with the highest scores, of
    equal ones those with the smaller doc_id (nulls last), then fewer features. Each row counts as a document; null texts have
    no features and weight 0. Empty tables give what they should: without documents no rows, without a target the gains
    come from the corpus alone. Other columns play no part. ``doc_id`` must be a whole number.

    Texts are read twice, for the counts and for the weights, and move nowhere; what is shuffled are blocks of the ranges
    that the draw reaches. Borders between ranges come from a sample of keys, of which the driver holds some for each
    range; they name a row besides its score, so rows that are all equal are split evenly too. Where they lie doesn't
    change the result.
    """
    scored = weighed(docs, gains(docs, target, text, target_text), text).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "scored")
    keyed = scored.where(F.col("n_words") >= LEAST_WORDS).select(
        (-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "n_features", "row", "weight"
    )
    many = keyed.count()
    draw = PERCENT * many // 100
    result = ["doc_id", "n_features", "weight", "score", "rank"]
    undrawn = scored.withColumn("rank", F.lit(None).cast("long"))
    if not draw:
        return undrawn.select(*result)
    ranges = -(-many // IN_A_RANGE)
    sample = sorted(map(tuple, keyed.select(*KEY).sample(min(1.0, SAMPLES * ranges / many), 1).collect())) if ranges > 1 else []
    borders = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []
    sizes = dict(map(tuple, _ranged(keyed, borders).groupBy("range").agg(F.count(F.lit(1))).collect()))
    starts = [0]
    for r in range(len(borders)):
        starts.append(starts[-1] + sizes.get(r, 0))
    reached = sum(s < draw for s in starts)
    # Ranges beyond the draw come back as they are; the others go through the merge.
    near = _upto(borders[reached - 1]) if reached <= len(borders) else F.lit(True)
    blocks = keyed.where(near).select(*KEY, "weight").mapInArrow(_runs(borders[: reached - 1]), "range long, " + ", ".join(f"{c} long" for c in KEY) + ", block binary")
    dealt = blocks.repartition(reached, "range").sortWithinPartitions("range", *KEY)
    drawn = dealt.mapInArrow(_drawn(starts, draw), "doc_id long, n_features long, weight long, score long, rank long")
    near_row = scored.withColumns({"down": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0))})
    rest = near_row.where(~((F.col("n_words") >= LEAST_WORDS) & near)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*result).unionByName(rest.select(*result))


def _upto(border: tuple) -> Column:
    """Whether a row's key isn't beyond ``border``."""
    return F.struct(*KEY) <= F.struct(*(F.lit(int(x)).cast("long").alias(c) for c, x in zip(KEY, border, strict=True)))


def _ranged(keyed: DataFrame, borders: list[tuple]) -> DataFrame:
    """The key range of each row."""

    @F.arrow_udf("int")
    def range_of(*key: pa.Array) -> pa.Array:
        from bisect import bisect_left

        return pa.array([bisect_left(borders, k) for k in zip(*(c.to_pylist() for c in key), strict=True)], pa.int32())

    return keyed.select(range_of(*KEY).alias("range"))
