"""What the training-data operators share: word rules, shared tables and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.shared import settled as stored

# A word and the white space between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    """Only A-Z change, whatever the locale."""
    return F.translate(c, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def others(df: DataFrame, own: list[str]) -> list[str]:
    """The columns of ``df`` but those that an operator gives itself, whatever their case."""
    gone = {c.lower() for c in own}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(columns: list[str]) -> list[str]:
    """Names as Spark takes them for one column each, whatever they hold."""
    return [f"`{c.replace('`', '``')}`" for c in columns]


def hashable(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of ``columns`` that Spark can hash."""
    return [c for c in columns if not any(t in df.schema[c].dataType.simpleString() for t in ("map<", "variant"))]


def sized_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` don't exceed ``most``; else a shuffled join stays."""
    return F.broadcast(df) if rows <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, rows: int, in_a_part: int) -> int:
    """Parts of about ``in_a_part`` rows; no fewer than the session's shuffles have."""
    return max(partitions(spark), -(-rows // in_a_part))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = stored(both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low")), "star-lows")
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("src").agg(F.min("dst").alias("low")), "star-lows")
    moved = edges.join(least, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(least.select("src", F.col("low").alias("dst"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (src, dst longs): a row (node, component) for each node of an edge.

    The component is its smallest node. Loops and repeated edges do no harm; no edges give no rows. Alternates large and
    small stars until the edges stay as they are: a few rounds, each of partial minima and of joins with them. Minima are
    stored before they are joined: both sides of a join are then shuffled for it alone, and Spark can split a hot node.
    """
    now = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "star-edges")
    # Two sums of hashes tell apart the edge sets of successive rounds.
    mark = [F.count(F.lit(1)), F.sum(F.hash("src", "dst").cast("long")), F.bit_xor(F.xxhash64("src", "dst"))]
    before, after = None, now.agg(*mark).first()
    while after[0] and before != after:
        now = stored(_small_star(stored(_large_star(now), "star-edges")), "star-edges")
        before, after = after, now.agg(*mark).first()
    members = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return members.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
