"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a slope, by which its share of the demand changes over training time t from 0 to 1. The
schedule's integral tells how many words of a source are due by t; inverting it at a document's place in its source's
running sum of words gives the document's position, and range-sorting the positions gives the training order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import SPACE, hashable, others, parts_for, quoted, stored

# Weights of the sources in order, repeating; what a source may be repeated at most.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3.0
#: How far each weight's share rises (above 0) or falls over training time; its integral at t is t + slope * (t * t - t).
SLOPES = (-0.5, 0.25, 0.5)
#: Documents of a source that are summed up by one window, about; how many such buckets a source has at least; rows of a part.
IN_A_BUCKET, LEAST_BUCKETS, IN_A_PART = 10_000, 256, 50_000


def words(text: Column) -> Column:
    """How many words a text has; null has none."""
    body = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(body, SPACE), lambda w: w != "")).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``number``, each one's place from 0 by code point, null last.

    Rows are sorted in ranges; a row's place is its place in its range after the sizes of the ranges before.
    """
    sorted_ = stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("__range", F.spark_partition_id()), "sources")
    counts = sorted_.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect()  # one row for each range
    before, total = {}, 0
    for r in counts:
        before[r[0]] = total
        total += r["n"]
    if not before:
        return sorted_.drop("__range").withColumn("number", F.lit(0).cast("long"))
    start = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("__range"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(F.col("source").asc_nulls_last()))
    return sorted_.withColumn("number", (start + own - 1).cast("long")).drop("__range")


def by_place(values: tuple[float, ...]) -> Column:
    """The value whose turn it is at ``number``; values repeat."""
    return reduce(lambda out, k: out.when(F.pmod(F.col("number"), F.lit(len(values))) == k, values[k]), range(1, len(values)), F.when(F.lit(False), 0.0)).otherwise(values[0])


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with ``number``, ``weight`` and ``target``.

    The sum of all sizes is shared by weight; a target stops at ``most`` times its source's size, and the excess is
    shared anew by weight among the sources below theirs until none is above. ``most`` is at least 1, so it ends with
    the whole sum shared. Each turn is one sum over the table of sources.
    """
    table = stored(numbered(sizes).withColumn("weight", by_place(weights)), "weighted-sources")
    cap, want = F.col("source_size") * most, F.col("weight")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, count = 0.0, -1
    while True:
        full = cap <= want * level
        r = table.agg(F.sum(F.when(full, cap)).alias("spent"), F.sum(F.when(~full, want)).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if r["n"] == count or not r["weight"]:
            break
        count, level = r["n"], max(level, (total - (r["spent"] or 0.0)) / r["weight"])
    return table.withColumn("target", F.least(cap.cast("double"), want * level))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: float = MOST_REPEATS, source: str = "source", size: str = "size") -> DataFrame:
    """All rows and columns of ``docs`` with ``source_size``, ``target``, ``copies``, ``taken`` and ``positions``.

    ``size`` is a column of words (null counts as 0). A source's documents stand in an order by hash; its words are dealt
    round and round in that order until the target is reached: a document has a copy for each round in which its middle
    lies before the target, so ``most`` copies at most, and the words taken differ from the target by half a document.
    ``positions`` has the training time of each copy. Documents without words are taken once, at the end of what goes
    before them. Rows that are equal in all columns take turns. Own columns with these names are replaced.

    A source's running sum is that of its buckets of hashes, then that within a bucket, so no window holds a whole source.
    Sizes are worked out and stored once, and all sums are taken from there.
    """
    own = ["source_size", "target", "copies", "taken", "positions"]
    kept = others(docs, own)
    words_of = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    # The table's own columns stand in one struct, so that none can clash with a name used here.
    df = docs.select(F.struct(*quoted(kept)).alias("row"), F.col(source).alias("source"), words_of.alias("size"), F.xxhash64(*quoted(sorted(hashable(docs, kept)))).alias("order"))
    sizes = stored(df.select("source", "size", "order"), "sizes")
    rows = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "source-sizes")
    most_rows = rows.agg(F.max("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << (most_rows // IN_A_BUCKET).bit_length())
    bucket = F.shiftrightunsigned(F.col("order"), 64 - (buckets.bit_length() - 1)).cast("int").alias("bucket")
    table = targets(rows.drop("n"), weights, most)
    sums = sizes.groupBy("source", bucket).agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("start"))
    table = table.select(F.col("source").alias("s"), "source_size", "target", by_place(slopes).alias("slope"))
    # One small row for each source and bucket; stored, so that the join can split what is hot.
    starts = stored(starts.join(table, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("bucket").alias("b"), "start", "source_size", "target", "slope"), "bucket-starts")
    within = Window.partitionBy("source", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", bucket).withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    both = df.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    begin = F.col("start") + F.col("within")
    middle = begin + F.col("size") / 2
    rounds = F.when(F.col("source_size") > 0, F.ceil((F.col("target") - middle) / F.col("source_size"))).otherwise(1).cast("int")
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(rounds, F.lit(int(most))))).otherwise(1)
    both = both.withColumn("copies", copies).withColumn("begin", begin)
    due = lambda k: F.when(F.col("target") > 0, F.least(F.lit(1.0), (F.col("begin") + k * F.col("source_size")) / F.col("target"))).otherwise(0.0)
    a = F.col("slope")
    when = lambda y: 2 * y / (1 - a + F.sqrt((1 - a) * (1 - a) + 4 * a * y))
    turns = F.filter(F.array(*(F.lit(k) for k in range(int(most)))), lambda k: k < F.col("copies"))
    # Only then the own columns come out: a name in a lambda could be taken for one of theirs.
    told = both.select("row", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.transform(turns, lambda k: when(due(k))).alias("positions"))
    return told.select("row.*", *own)


def ranked(ordered: DataFrame) -> DataFrame:
    """``ordered``, as ``training_order`` gives it, with ``place``: each copy's from 1 on in the whole order. Stored.

    A copy's place is that in its range after the sizes of the ranges before, of which the driver holds one number each.
    """
    rows = stored(ordered.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "training-order")
    before, total = {}, 0
    for r in rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).orderBy("range").collect():
        before[r["range"]] = total - r["first"]
        total += r["n"]
    if not before:
        return rows.withColumn("place", F.lit(0).cast("long")).drop("range", "at")
    shift = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("range"))
    return rows.withColumn("place", (F.col("at") + shift + 1).cast("long")).drop("range", "at")


def training_order(mixed: DataFrame, rows: int = 0) -> DataFrame:
    """A row for each copy in ``mixed`` with its ``position``, range-sorted by it; ties stand in an order by hash.

    ``rows``, about how many rows ``mixed`` has, tells how many ranges there are: one for ``IN_A_PART`` of them.
    """
    own = ["source_size", "target", "copies", "taken", "positions", "position"]
    copies = mixed.select(*quoted(others(mixed, own)), F.explode("positions").alias("position"))
    order = ["position", F.xxhash64(*quoted(hashable(mixed, others(mixed, own))))]
    return copies.repartitionByRange(parts_for(mixed.sparkSession, rows, IN_A_PART), *order).sortWithinPartitions(*order)
