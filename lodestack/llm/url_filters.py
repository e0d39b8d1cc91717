"""URL filters as a sort-merge range join.

A host is keyed by its labels from the last to the first, each followed by ``/``; so a rule's host and all of its
subdomains are one interval of keys. URLs are dealt into ranges of keys, each rule goes to the ranges that its interval
meets, and a sweep over the sorted keys of a range keeps a stack of the hosts whose intervals are open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestack.llm.common import hashable, lower_ascii, others, parts_for, quoted

#: URLs looked at for each range when the borders between ranges are set, about, and URLs in a range.
SAMPLES, IN_A_RANGE = 40, 1_000_000

OWN = ["host", "path", "rule", "verdict"]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


class Open:
    """A host whose interval is open: its rules by path."""

    def __init__(self, key: str):
        self.key, self.rules, self.sizes = key, {}, []

    def add(self, host: str, path: str, verdict: str) -> None:
        if path not in self.rules:
            self.rules[path] = (len(host) + len(path), host + path, verdict)
            self.sizes = sorted({len(p) for p in self.rules}, reverse=True)

    def fitting(self, path: str) -> tuple[int, str, str] | None:
        return next((self.rules[path[:n]] for n in self.sizes if path[:n] in self.rules), None)


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    stack: list[Open] = []
    part = None
    for batch in batches:
        found: list[list] = [[], [], [], [], []]
        told = [batch.column(c).to_pylist() for c in ("part", "key", "is_url", "host", "path", "verdict")]
        for i, (p, key, is_url, host, path, verdict) in enumerate(zip(*told, strict=True)):
            if p != part:
                part = p
                stack.clear()
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if not is_url:
                if not stack or stack[-1].key != key:
                    stack.append(Open(key))
                stack[-1].add(host, path, verdict)
                continue
            # The longest rule wins; of equally long ones that of the more special host, which lies higher on the stack.
            best = max((f for o in reversed(stack) if (f := o.fitting(path))), key=lambda f: f[0], default=None)
            for column, value in zip(found, (i, host, path, best[1] if best else None, best[2] if best else default), strict=True):
                column.append(value)
        rows = batch.column("row").take(pa.array(found[0], pa.int64()))
        yield pa.RecordBatch.from_arrays([rows, *(pa.array(x, pa.string()) for x in found[1:])], ["row", *OWN])


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """All rows and columns of ``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``; a rule fits its host and all subdomains if the url's path starts with its
    own. The longest fitting rule (host and path together) wins. Without one ``rule`` is null and ``verdict`` is
    ``default``; so it is for a null url or one without ``://``, whose host and path are empty. Of rules with the same
    host and path the verdict that sorts first counts; A-Z of hosts are lower-cased; rules with a null or empty host are left out. Own columns with the
    names of the four, in any case, are replaced; others may have any name. Repeated rows are judged each; empty tables
    give what they should.

    Borders come from about ``SAMPLES`` urls for each range of ``IN_A_RANGE`` urls or fewer, so the driver holds some keys for
    each range. A border names a row's hash besides its key, and the sample is of rows at random: urls of one host, or
    of one and the same url, are split evenly over as many ranges as they fill. Copies of a row that are equal in every
    column are told apart by the input partition that they stand in.
    """
    spark, rows = urls.sparkSession, urls.count()
    n = parts_for(spark, rows, IN_A_RANGE)
    kept = others(urls, OWN)
    # The table's own columns stand in one struct, so that none can clash with a name used here.
    spread = F.xxhash64(*quoted(hashable(urls, kept)), F.spark_partition_id())
    keyed = urls.select(F.struct(*quoted(kept)).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), spread.alias("hash")).withColumn("key", host_key(F.col("host")))
    sample = sorted((r[0], r[1]) for r in keyed.select("key", "hash").sample(min(1.0, SAMPLES * n / max(1, rows)), 1).collect())
    borders = [sample[k * len(sample) // n] for k in range(1, n)] if sample else []

    @F.arrow_udf("int")
    def range_of(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array([bisect_right(borders, x) for x in zip(keys.to_pylist(), hashes.to_pylist(), strict=True)], pa.int32())

    @F.arrow_udf("array<int>")
    def ranges_of(keys: pa.Array) -> pa.Array:
        # "0" follows "/": it ends the interval of all keys that begin with a host's key.
        low = -(1 << 63)
        return pa.array([list(range(bisect_right(borders, (k, low)), bisect_left(borders, (k[:-1] + "0", low)) + 1)) for k in keys.to_pylist()], pa.list_(pa.int32()))

    good = rules.where("host <> ''").groupBy(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.min("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))
    dealt = keyed.withColumn("part", range_of("key", "hash")).withColumns({"is_url": F.lit(True), "verdict": F.lit(None).cast("string")}).drop("hash")
    sent = good.withColumn("part", F.explode(ranges_of("key"))).withColumn("is_url", F.lit(False))
    both = dealt.unionByName(sent, allowMissingColumns=True).repartitionById(n, F.col("part")).sortWithinPartitions("part", "key", "is_url", "path")
    out = StructType([StructField("row", keyed.schema["row"].dataType), *(StructField(c, StringType()) for c in OWN)])
    return both.mapInArrow(lambda batches: _sweep(batches, default), out).select("row.*", *OWN)
