"""Which texts hold which anchors: a join on one gram of each anchor, verified by digests of what stands around it in the texts.

A gram is a run of bytes. Of a long anchor only the least hash of each window of neighbouring grams counts, and so it does
in texts: a text that holds the anchor holds its windows too. Of the grams that an anchor has, the one that the fewest
texts of a sample have is its key. Of a text only the grams that may be keys leave the task, with their places: a Bloom filter
of all keys tells. Anchors go by 16 bytes of their SHA-256 until they are found: their own text is shuffled once, at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.sources.shared import settled

#: Bytes of a gram and grams of a window, for anchors with so many bytes or more; shorter ones are grams themselves.
LONG, MIDDLE = (16, 16), (8, 1)
#: Words of 8 bytes of anchors' keys that are broadcast at most, and those of a key; more are joined by a shuffle.
GRAMS_SENT, WORDS_OF_A_KEY = 500_000, 4
#: Texts that tell which grams are frequent, and frequent grams that are told: they order an anchor's grams, nothing else.
SAMPLED, FREQUENT = 2_000, 500_000
#: Bits of the Bloom filter for a key, and in all (as a power of two): beyond that more grams that are no keys are joined in vain.
BITS_OF_A_KEY, MOST_BITS = 16, 28
#: Rows that leave a task at once.
ROWS_AT_ONCE = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = (0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _shape(size: int) -> tuple[int, int]:
    return LONG if size >= sum(LONG) - 1 else MIDDLE if size >= MIDDLE[0] else (size, 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Text:
    """A text's hashes of grams. Those of up to 8 bytes are the bytes themselves, mixed one to one."""

    def __init__(self, raw: bytes):
        self.size, self.packed = len(raw), {1: np.frombuffer(raw, np.uint8).astype(np.uint64)}

    def _pack(self, q: int) -> np.ndarray:
        if q not in self.packed:
            half, n = q // 2, self.size - q + 1
            self.packed[q] = (self._pack(q - half)[:n] << np.uint64(8 * half)) | self._pack(half)[q - half :]
        return self.packed[q]

    def hashes(self, q: int) -> np.ndarray:
        """Of the grams of ``q`` bytes, 16 or up to 8, by place."""
        if self.size < q:
            return np.zeros(0, np.uint64)
        if q <= 8:
            return _mixed(self._pack(q) ^ np.uint64(q << 56))
        p = self._pack(q // 2)
        return _mixed(_mixed(p[: -(q // 2)]) * _BASE + p[q // 2 :])

    def least(self, q: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the grams of ``q`` bytes that are the least of some window of ``w``."""
        h = self.hashes(q)
        if len(h) < w:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if w == 1:
            return np.arange(len(h)), h.view(np.int64)
        least = _over(np.minimum, h, w)
        # A gram counts if a window that it is in has no lesser one: the largest of the least of its windows is its own.
        edge = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero(_over(np.maximum, np.concatenate([edge, least, edge]), w) == h)
        return at, h[at].view(np.int64)


def _over(ufunc: np.ufunc, h: np.ndarray, w: int) -> np.ndarray:
    """``ufunc``, least or largest, of each window of ``w``."""
    size = 1
    while 2 * size <= w:
        h, size = ufunc(h[:-size], h[size:]), 2 * size
    return ufunc(h[: len(h) - (w - size)], h[w - size :]) if size < w else h


def grams(raw: bytes, q: int, w: int) -> np.ndarray:
    """The distinct hashes of a text's grams of ``q`` bytes that are the least of some window of ``w``."""
    return np.unique(_Text(raw).least(q, w)[1])


def _place(gram: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The ``k``-th place of each gram in a filter of two to the power of ``bits``."""
    return ((gram.view(np.uint64) * np.uint64(_SPREAD[k])) >> np.uint64(64 - bits)).view(np.int64)


def _frequent(chunks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams that several of the sampled texts have, in order, and how many have each."""
    share = max(1, chunks.count() // SAMPLED)
    some = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(share)) == 0).select(F.col("chunk_text").cast("binary")).repartition(1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [grams(raw.as_py() or b"", *s) for batch in batches for raw in batch.column(0) for s in (LONG, MIDDLE)]
        gram, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
        many = np.flatnonzero(n > 1)
        many = np.sort(many[np.argsort(-n[many], kind="stable")[:FREQUENT]])
        yield pa.RecordBatch.from_arrays([pa.array(gram[many]), pa.array(n[many])], ["gram", "n"])

    told = some.mapInArrow(counted, "gram long, n long").toArrow()
    gram, n = (told.column(c).to_numpy() for c in ("gram", "n"))
    order = np.argsort(gram)
    return gram[order], n[order]


def _digest(raw: Column) -> Column:
    return F.substring(F.unhex(F.sha2(raw, 256)), 1, 16)


def named(anchors: DataFrame) -> DataFrame:
    """(id, anchor) of ``anchors`` that aren't null or empty, with repeats."""
    return anchors.where("anchor <> ''").select(_digest(F.col("anchor").cast("binary")).alias("id"), "anchor")


def _keyed(anchors: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, gram, place, size): each anchor's gram that is least often among the frequent ones, its place and the anchor's bytes."""
    known, n = np.append(often[0], 0), np.append(often[1], 0)

    def key(raw: bytes) -> tuple[int, int]:
        places, hashes = _Text(raw).least(*_shape(len(raw)))
        own, first = np.unique(hashes, return_index=True)
        at = np.searchsorted(known[:-1], own)
        k = np.argmin(np.where(known[at] == own, n[at], 0))
        return int(own[k]), int(places[first[k]])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            told = [key(r.as_py()) for r in raw]
            gram, place = (pa.array([t[j] for t in told], kind) for j, kind in ((0, pa.int64()), (1, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), gram, place, pc.binary_length(raw)], ["id", "gram", "place", "size"])

    return named(anchors).mapInArrow(keyed, "id binary, gram long, place int, size int")


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter of ``n`` keys' grams: words of 64 bits, a power of two of them."""
    bits = min(MOST_BITS, max(6, (BITS_OF_A_KEY * n - 1).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.concatenate([_place(gram, k, bits) for k in range(len(_SPREAD))])
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((at & 63).astype(np.int32))], ["word", "bit"])

    bit = F.expr("shiftleft(1L, bit)")
    told = keys.select("gram").mapInArrow(placed, "word long, bit int").groupBy("word").agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[told.column("word").to_numpy()] = told.column("bits").to_numpy()
    return out


def _coarse(keys: DataFrame) -> dict[int, np.ndarray]:
    """For each size of grams of which every one counts: which first 16 bits keys have. It fits a processor's cache, and of few keys it rules out most grams."""
    first = F.shiftrightunsigned("gram", 48)
    q = F.least("size", F.lit(MIDDLE[0])).alias("q")
    words = keys.where(F.col("size") < sum(LONG) - 1).groupBy(q, F.shiftright(first, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(gram, 48) & 63 as int))")).alias("bits"))
    out: dict[int, np.ndarray] = {}
    for size, word, bits in words.collect():  # 1,024 words for each of eight sizes at most
        out.setdefault(size, np.zeros((1 << 10, 64), bool))[word] = (np.int64(bits) >> np.arange(64)) & 1
    return {size: told.ravel() for size, told in out.items()}


def _listed(texts: DataFrame, shapes: list[tuple[int, int]], among: np.ndarray, coarse: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(chunk_id, gram, at) of ``texts``: the distinct grams of all ``shapes`` that may be keys, and where they stand.

    Of grams that are anchors themselves the first place is told: there the whole anchor stands.
    """
    bits = (len(among) - 1).bit_length() + 6

    def may_be(own: np.ndarray) -> np.ndarray:
        """Places in ``own`` of the grams that may be keys."""
        kept = np.arange(len(own))
        for k in range(len(_SPREAD)):
            at = _place(own[kept], k, bits)
            kept = kept[((among[at >> 6] >> (at & 63)) & 1) == 1]
        return kept

    def of(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Grams, how many places each has, and these."""
        text = _Text(raw)
        for q, w in shapes:
            places, own = text.least(q, w)
            if coarse and q in coarse:
                kept = np.flatnonzero(coarse[q][own.view(np.uint64) >> np.uint64(48)])
                places, own = places[kept], own[kept]
            kept = may_be(own)
            places, own = places[kept], own[kept]
            order = np.argsort(own, kind="stable")
            gram, first, n = np.unique(own[order], return_index=True, return_counts=True)
            if q < MIDDLE[0]:
                order, n = order[first], np.ones(len(gram), np.int64)
            yield gram, n, places[order]

    def rows(ids: pa.Array, held: list) -> pa.RecordBatch:
        row, gram, n, place = (np.concatenate(c) for c in zip(*held, strict=True))
        at = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(place.astype(np.int32)))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(gram), at], ["chunk_id", "gram", "at"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, many = [], 0
            for i, raw in enumerate(batch.column(1)):
                for gram, n, place in of(raw.as_py() or b""):
                    held.append((np.full(len(gram), i), gram, n, place))
                    many += len(gram) + len(place)
                if many >= ROWS_AT_ONCE:
                    yield rows(batch.column(0), held)
                    held, many = [], 0
            if many:
                yield rows(batch.column(0), held)

    return texts.select("chunk_id", F.col("chunk_text").cast("binary")).mapInArrow(listed, f"chunk_id {dict(texts.dtypes)['chunk_id']}, gram long, at array<int>")


def _sent(rows: DataFrame, many: int) -> DataFrame:
    return F.broadcast(rows) if many <= GRAMS_SENT else rows


def found(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(chunk_id, id) as ``holding``, the anchor by its id (see ``named``)."""
    keys = settled(_keyed(anchors, _frequent(chunks)).dropDuplicates(["id"]), "anchor-keys")
    n = keys.count()
    shapes = [_shape(r[0]) for r in keys.select(F.least("size", F.lit(sum(LONG) - 1)).alias("n")).distinct().orderBy("n").collect()]  # as many rows as short lengths
    pairs = _listed(chunks, sorted(set(shapes)), _filter(keys, n), _coarse(keys)).join(_sent(keys, WORDS_OF_A_KEY * n), "gram")
    both = pairs.join(chunks.select("chunk_id", F.col("chunk_text").cast("binary").alias("raw")), "chunk_id")
    stands = lambda p: (p >= F.col("place")) & (_digest(F.substring(F.col("raw"), p - F.col("place") + 1, F.col("size"))) == F.col("id"))
    return both.where(F.exists("at", stands)).select("chunk_id", "id")


def texts_of(anchors: DataFrame) -> DataFrame:
    """(id, anchor) of the distinct ``anchors``."""
    return named(anchors).groupBy("id").agg(F.first("anchor").alias("anchor"))


def holding(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(chunk_id, anchor) for each of the distinct ``anchors`` that stands in the text of ``chunks`` (chunk_id, unique, and chunk_text).

    Null and empty anchors stand nowhere. Anchors can be many and of any length: their keys are broadcast if they are counted and
    small, else shuffled. The driver holds the filter (32 MB at most) and the sample's frequent grams. ``anchors`` is read twice.
    """
    return found(chunks, anchors).join(texts_of(anchors), "id").select("chunk_id", "anchor")
