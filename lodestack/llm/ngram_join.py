"""N-gram Jaccard join by parity sketches.

Texts are sets of hashed five-word shingles. XOR-ing the hashes of each of k groups of a set gives a parity sketch: a
shingle that only one of two sets has changes one group at most, so sketches differ in no more groups than the sets'
symmetric difference has shingles. Two sets that reach the threshold differ in d shingles at most, d set by their sizes;
of any d + 1 groups that are not empty one is equal in both. Each set is listed under its first d + 1 groups, per band of
sizes, and sets under the same key are candidates. One-bit sketches, whose Hamming distance bounds the difference from
below too, thin these out, and what is left is verified on the sets.

Only whether documents hang together is wanted, so a key's sets are first held against its smallest one; after
that only sets which hang together with different ones are compared with each other, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import components, parts_for, sized_broadcast, stored
from lodestack.llm.shingles import mixed, shingle_sets

#: Documents whose shingles tell which ones are frequent: this many, or one in ``SHARE`` if that is more. A shingle that so many
#: of them have is listed last, and that many such shingles are held by a task; that only orders keys, no link hangs on it.
SAMPLE, SHARE, FREQUENT, MOST_FREQUENT = 8_000, 64, 6, 500_000
#: Sets under one key that one task compares with each other, bytes of their parities, and sets that a stretch of texts hands on one by one.
BLOCK, BLOCK_BYTES, RUN = 256, 16 << 20, 16
#: Shingles of all documents for each part that keys are dealt into, about half a key of 28 bytes each, and rows of a part of pairs.
FOR_A_PART, IN_A_PART = 16_000_000, 500_000
#: Ids of documents that are broadcast at most (8 bytes each), and keys (16 bytes each); more are joined by a shuffle.
IDS_SENT, KEYS_SENT = 500_000, 50_000
_COUNTED = np.uint64(0x5851F42D4C957F2D)


def most_different(a, b):
    """The largest symmetric difference of sets of a and b shingles with 100 * intersection >= 75 * union."""
    return (a + b) // 7


def bands(n: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1  # floor of the binary logarithm


def groups_of(band: int) -> int:
    """How many groups a band's sketches have; 0: each shingle is a group. So many that far more than d aren't empty."""
    return 0 if band < 4 else {4: 1024, 5: 128, 6: 128, 7: 192}.get(band, 1 << band)


def identities(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number for each set that equal sets share: 0 for the empty one."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ _COUNTED), dtype=np.uint64)])
    ends = np.cumsum(n)
    return np.where(n > 0, mixed(upto[ends] - upto[ends - n]), np.uint64(0)).view(np.int64)


def parities(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """One-bit sketches: bit (hash mod m) counts its shingles' parity; m is four times the power of two above n.

    The wider they are, the fewer differing shingles fall on one bit and cancel out, and the nearer the distance is to theirs.
    """
    out: list[bytes] = [b""] * len(n)
    ends, m_of = np.cumsum(n), np.maximum(64, 8 << bands(n))
    for m in np.unique(m_of[n > 0]):
        rows = np.flatnonzero((m_of == m) & (n > 0))
        row = np.repeat(np.arange(len(rows)), n[rows])
        at = np.repeat(ends[rows] - n[rows] - (np.cumsum(n[rows]) - n[rows]), n[rows]) + np.arange(n[rows].sum())
        bits = np.bincount(row * m + (h[at] & np.uint64(m - 1)).astype(np.int64), minlength=len(rows) * m) & 1
        packed = np.packbits(bits.astype(np.uint8).reshape(len(rows), m), axis=1, bitorder="little")
        for r, p in zip(rows.tolist(), packed, strict=True):
            out[r] = p.tobytes()
    return out


def keys_of(h: np.ndarray, n: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which sets are listed, and the row of each. Groups of frequent shingles alone are listed last.

    A band lists its own sets and those of the band below that may reach a set of its own. A set with d groups or fewer,
    which by chance comes less often than once in 10**15 sets (see ``groups_of``), is listed under all of them: so it meets
    every set that has enough.
    """
    ends, own = np.cumsum(n), bands(n)
    known = np.isin(h, frequent) if len(frequent) else np.zeros(len(h), bool)
    keys, rows = [], []
    for band in range(int(own.max(initial=0)) + 2):
        guest = (own == band - 1) & (4 * n >= 3 << band)
        idx = np.flatnonzero(((own == band) | guest) & (n > 0))
        if not len(idx):
            continue
        size = n[idx]
        at = np.repeat(ends[idx] - size - (np.cumsum(size) - size), size) + np.arange(size.sum())
        x, row, rare = h[at], np.repeat(np.arange(len(idx)), size), ~known[at]
        group = np.zeros(len(x), np.uint64)
        k = groups_of(band)
        if k:
            group = ((x >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # ascending, as the hashes are
            starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (row[1:] != row[:-1])]))
            x, row, group, rare = np.bitwise_xor.reduceat(x, starts), row[starts], group[starts], np.logical_or.reduceat(rare, starts)
        partner = np.where(guest[idx], 4 * size // 3, np.minimum(4 * size // 3, (2 << band) - 1))
        d = most_different(size, partner)
        order = np.lexsort((np.arange(len(x)), ~rare, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(idx)))[row]
        first = rank <= d[row]
        keys.append(mixed(x[order][first] ^ mixed(group[order][first] * np.uint64(64) + np.uint64(band))))
        rows.append(idx[row[first]])
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _runs(keys: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, member) of what stands in order, and the start and length of each key's run."""
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (members[1:] != members[:-1])
    keys, members = keys[fresh], members[fresh]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys, members, starts, np.diff(np.append(starts, len(keys)))


def text_id() -> Column:
    """Tells texts of one document apart."""
    return F.xxhash64("text").alias("text_id")


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (a hash of the text), n, set (its identity) and parity of every document."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for h, n in shingle_sets(batch.column(2)):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(n)) for k in (0, 1)), pa.array(n), pa.array(identities(h, n)), pa.array(parities(h, n), pa.binary())], ["doc_id", "text_id", "n", "set", "parity"])
                at += len(n)

    return docs.select(F.col("doc_id").cast("long"), text_id(), "text").mapInArrow(described, "doc_id long, text_id long, n long, set long, parity binary")


def _frequent(docs: DataFrame, many: int) -> np.ndarray:
    """Shingles that a good many of a sample of the ``many`` documents have."""
    of = 1 << 20
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(of)) < min(of, of * max(SAMPLE, many // SHARE) // max(1, many))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, _ in shingle_sets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    rows = docs.where(drawn).select("text").mapInArrow(listed, "h long")
    often = rows.groupBy("h").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).select("h")
    return np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64))


def _listed(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Rows (key, set, low): every key with the sets under it; equal sets of a stretch of texts have one row.

    Where a stretch has over ``RUN`` sets under one key, only three of them, its smallest one among them, stand for it in
    rows whose ``low`` is null; besides, each of them has a row with that smallest one as ``low``, which need not meet the
    key's other rows. So a very frequent key is summed up before anything is shuffled.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in shingle_sets(batch.column(0)):
                keys, rows = keys_of(h, n, frequent)
                members = identities(h, n)[rows]
                order = np.lexsort((members, keys))
                keys, members, starts, length = _runs(keys[order], members[order])
                place, low = np.arange(len(keys)) - np.repeat(starts, length), np.repeat(members[starts], length)
                many = np.repeat(length > RUN, length)
                few = ~many | (place < 3)
                keys = keys.view(np.int64)
                told = [np.concatenate([x[few], y[many]]) for x, y in ((keys, keys), (members, members), (low, low))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, told[:2]), pa.array(told[2], mask=np.arange(len(told[2])) < few.sum())], ["key", "set", "low"])

    return docs.select("text").mapInArrow(listed, "key long, set long, low long")


def _emitted(keys: np.ndarray, members: np.ndarray, low: np.ndarray, whole: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, (keys, members, low)), pa.array(np.full(len(keys), whole))], ["key", "set", "low", "whole"])


def _shared(listed: DataFrame, parts: int) -> DataFrame:
    """Rows (key, set, low, whole): the sets under each key that more than two share, with the smallest of those seen together.

    The key of two sets has one row, with key 0, for the larger one. Keys are sorted by Spark, which spills; a task holds a
    batch of rows and the one row before it, whose key may go on. Rows that have their ``low`` already are ``whole``; they
    are dealt evenly.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            whole = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            key, member = (batch.column(c).to_numpy() for c in (0, 1))
            if whole.any():
                yield _emitted(key[whole], member[whole], batch.column(2).filter(pa.array(whole)).to_numpy(), True)
                key, member = key[~whole], member[~whole]
            if not len(key):
                continue
            if last is not None:
                key, member = np.append(last[0], key), np.append(last[1], member)
            key, member, starts, length = _runs(key, member)
            place, low = np.arange(len(key)) - np.repeat(starts, length), np.repeat(member[starts], length)
            if last is not None:
                place[: length[0]] += last[3]
                low[: length[0]] = last[2]
            yield from told(key[:-1], member[:-1], low[:-1], place[:-1], key[1:] != key[:-1])
            last = key[-1], member[-1], low[-1], place[-1]
        if last is not None:
            yield from told(*(np.array([x]) for x in last), np.array([True]))

    def told(key, member, low, place, ends) -> Iterator[pa.RecordBatch]:
        # Of two sets the second names the first, and that is all there is to compare; of more the first one has a row too.
        at, first = np.flatnonzero(place > 0), np.flatnonzero((place == 1) & ~ends)
        if len(at):
            lone = (place[at] == 1) & ends[at]
            yield _emitted(np.append(np.where(lone, 0, key[at]), key[first]), np.append(member[at], low[first]), np.append(low[at], low[first]), False)

    dealt = listed.withColumn("deal", F.when(F.col("low").isNull(), F.col("key")).otherwise(F.xxhash64("key", "set")))
    return dealt.repartition(parts, "deal").sortWithinPartitions("key", "set").select("key", "set", "low").mapInArrow(shared, "key long, set long, low long, whole boolean")


def _distance(a: bytes, b: bytes) -> int:
    """The Hamming distance of two parities, the longer one folded to the shorter's length."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _near_enough(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose sizes and parities allow a link."""

    @F.arrow_udf("boolean")
    def near(p: pa.Array, q: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        rows = zip(p.to_pylist(), q.to_pylist(), n.to_pylist(), m.to_pylist(), strict=True)
        return pa.array([_distance(a, b) <= most_different(i, j) for a, b, i, j in rows], pa.bool_())

    one = sets.select(F.col("set").alias("a"), F.col("n").alias("n"), F.col("parity").alias("p"))
    two = sets.select(F.col("set").alias("b"), F.col("n").alias("m"), F.col("parity").alias("q"))
    # Many pairs may share their smaller set: it is joined last, and nothing is shuffled after that, so Spark can split it.
    both = pairs.distinct().join(two, "b").join(one, "a").where("4 * least(n, m) >= 3 * greatest(n, m)")
    return stored(both.where(near("p", "q", "n", "m")).select("a", "b"), "near-pairs")


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of sets with 100 * intersection >= 75 * union, told from the texts of their documents."""
    wanted = stored(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct().join(sets, "set").select("doc_id", "set"), "wanted-sets")
    ids = sized_broadcast(wanted.select("doc_id"), wanted.count(), IDS_SENT)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in shingle_sets(batch.column(0)):
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(identities(h, n)), pa.array([h[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], ["set", "shingles"])

    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(x, y, strict=True):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= 75 * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    # Repeated rows of one id make a set come more than once.
    shingles = stored(docs.join(ids, "doc_id", "left_semi").select("text").mapInArrow(packed, "set long, shingles binary").dropDuplicates(["set"]), "shingles")
    one, two = shingles.select(F.col("set").alias("a"), F.col("shingles").alias("x")), shingles.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    return stored(pairs.join(two, "b").join(one, "a").where(linked("x", "y")).select("a", "b"), "links")


def _with_lows(shared: DataFrame) -> DataFrame:
    """(key, set, low) with the smallest set of each whole key: that of the rows that met each other."""
    hot = stored(shared.where("whole").select("key").distinct(), "hot-keys")
    met = shared.where("key <> 0 and not whole").join(sized_broadcast(hot, hot.count(), KEYS_SENT), "key", "left_semi")
    lows = stored(met.groupBy("key").agg(F.min("low").alias("least")), "key-lows")
    few = shared.where("key <> 0").join(sized_broadcast(lows, lows.count(), KEYS_SENT), "key", "left")
    return few.select("key", "set", F.coalesce("least", "low").alias("low")).unionByName(shared.where("key = 0").select("key", "set", "low"))


def _unsettled(lists: DataFrame, sets: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that share a key and don't hang together yet, as far as sizes and parities allow a link.

    Keys with the same smallest set are taken together, so that a pair which shares many keys is met few times: all sets
    of such keys are held against each other, whichever key they stand under. They are dealt into blocks, and each pair of
    blocks is one piece of work of bounded size.
    """
    told = sets.join(joined.select(F.col("node").alias("set"), F.col("component").alias("joined")), "set", "left").select("set", "n", "parity", F.coalesce("joined", "set").alias("joined"))
    rows = lists.where("key <> 0").join(told.select("set", "joined"), "set")
    open_ = stored(rows.groupBy("key").agg(F.min("joined").alias("lo"), F.max("joined").alias("hi")).where("lo <> hi").select("key"), "open-keys")
    members = lists.join(sized_broadcast(open_, open_.count(), KEYS_SENT), "key", "left_semi").select("low", "set").distinct()
    members = stored(members.join(told, "set"), "open-sets")
    blocks = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length("parity")) / BLOCK_BYTES)
    counts = stored(members.groupBy("low").agg(F.count(F.lit(1)).alias("m"), F.ceil(blocks).cast("int").alias("k")), "open-lows")
    parts = parts_for(lists.sparkSession, counts.agg(F.sum(F.col("m") * F.col("k"))).first()[0] or 0, IN_A_PART)
    rows = members.join(counts.drop("m"), "low").withColumn("block", F.pmod(F.xxhash64("set"), F.col("k")).cast("int"))
    twice = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least("block", j).cast("long") * F.col("k") + F.greatest("block", j))
    rows = rows.select(F.col("low").alias("key"), F.explode(twice).alias("work"), "block", "set", "n", "joined", "parity")
    rows = rows.repartition(parts, "key", "work").sortWithinPartitions("key", "work", "set")

    def pairs_of(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        block, ids, n, joined_ = (t.column(c).to_numpy() for c in ("block", "set", "n", "joined"))
        across, parity = len(np.unique(block)) > 1, t.column("parity").to_pylist()
        words = np.array([len(p) // 8 for p in parity])
        a, b = [], []
        for w in np.unique(words):  # each length with itself and the next longer one, folded
            same, longer = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
            x = np.frombuffer(b"".join(parity[i] for i in same), np.uint64).reshape(-1, w)
            y = np.frombuffer(b"".join(parity[i] for i in longer), np.uint64).reshape(-1, 2 * w)
            y, other = np.concatenate([x, y[:, :w] ^ y[:, w:]]), np.concatenate([same, longer])
            step = max(1, (1 << 20) // max(1, len(other) * w))
            for at in range(0, len(same), step):
                i = same[at : at + step]
                ok = (joined_[i][:, None] != joined_[other][None]) & (4 * np.minimum(n[i][:, None], n[other][None]) >= 3 * np.maximum(n[i][:, None], n[other][None]))
                ok &= (other[None] > i[:, None]) | (words[other] > w)[None]
                if across:
                    ok &= block[i][:, None] != block[other][None]
                r, c = np.nonzero(ok)
                if len(r):
                    good = np.bitwise_count(x[at + r] ^ y[c]).sum(axis=1) <= most_different(n[i[r]], n[other[c]])
                    a.append(ids[i[r[good]]])
                    b.append(ids[other[c[good]]])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(a or none), np.concatenate(b or none)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            t = rest if batch is None else batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if t is None or not t.num_rows:
                continue
            key, work = t.column("key").to_numpy(), t.column("work").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (work[1:] != work[:-1])])).tolist()
            ends = [*starts[1:], t.num_rows]
            if batch is not None:  # the last piece may go on in the next batch
                rest = t.slice(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
            found = [pairs_of(t.slice(s, e - s)) for s, e in zip(starts, ends, strict=True)]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return stored(rows.mapInArrow(compared, "a long, b long").distinct(), "unsettled-pairs")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id, group_id and text_id of every row of ``docs`` (doc_id, text; other columns are left out).

    Two documents link when 100 * intersection >= 75 * union of their sets; all links count, none are sampled or capped.
    ``component_id`` is the smallest doc_id reachable by links, a document's own if there are none; rows with one set
    share ``set_id``, and sets that hang together ``group_id``, though ids may repeat. Texts without words and null texts have no shingles and link with nothing. Rows without doc_id
    link with nothing and have no component. Repeated rows come back each. Sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    every = stored(_described(docs), "sets")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # One document stands for all that have its set; of an id with several texts each set has its own.
    sets = stored(every.where("n > 0 and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("parity").alias("parity")), "distinct-sets")
    parts = parts_for(spark, every.agg(F.sum("n")).first()[0] or 0, FOR_A_PART)
    lists = _with_lows(stored(_shared(_listed(docs, _frequent(docs, every.count())), parts), "shared-keys"))
    star = lists.where("set <> low").select(F.least("set", "low").alias("a"), F.greatest("set", "low").alias("b"))
    links = _verified(docs, sets, _near_enough(star, sets))
    edges = lambda df: df.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    joined = components(edges(links))
    more = _verified(docs, sets, _unsettled(lists, sets, joined))
    joined = stored(components(edges(links.union(more))), "components")
    lows = stored(joined.join(sets.select("set", "doc_id"), F.col("node") == F.col("set")).groupBy("component").agg(F.min("doc_id").alias("low")), "component-lows")
    of_set = sets.join(joined, F.col("set") == F.col("node"), "left").join(lows, "component", "left").select("set", F.coalesce("low", "doc_id").alias("component_id"), F.coalesce("component", "set").alias("group_id"))
    of_set = stored(of_set, "set-components")
    some = every.where("n > 0 and doc_id is not null").join(of_set, "set").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("set").alias("set_id"), "group_id", "text_id")
    rest = every.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("set").alias("set_id"), F.lit(None).cast("long").alias("group_id"), "text_id")
    return some.unionByName(rest)
