"""Metrics of the query log (total_ms, embed_ms, retrieve_ms, top_score, is_empty_recall, created_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.sources.shared import settled

#: Distinct values, of all groups together, that one task puts in order.
IN_A_RANGE = 1_000_000
SHARE = 0.95


def nearest_ranks(rows: DataFrame, column: str, share: float, key: Column) -> DataFrame:
    """(key, value): for each key the value of ``column`` at rank ceil(share * n), without interpolation; nulls don't count.

    Selection by rank over counted values: equal values are counted, the counts lie in ranges by key and value, and sums over
    ranges tell in which one a key's rank falls. Only that range's values are then put in order. A hot value is one count, a
    hot key fills many ranges, and no task orders more than a range. ``key`` can be a struct; null keys are a key.
    """
    counted = settled(rows.where(F.col(column).isNotNull()).groupBy(key.alias("key"), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")), "counted-values")
    ranges = max(1, -(-counted.count() // IN_A_RANGE))
    # Stored: where the borders lie mustn't change between the sums and the look into a range.
    placed = settled(counted.repartitionByRange(ranges, "key", "value").withColumn("range", F.spark_partition_id()), "placed-values") if ranges > 1 else counted.withColumn("range", F.lit(0))
    sums = placed.groupBy("key", "range").agg(F.sum("n").alias("own"))
    one_key = Window.partitionBy("key")  # a row for each range that the key reaches
    starts = sums.withColumns({"before": F.sum("own").over(one_key.orderBy("range")) - F.col("own"), "rank": F.greatest(F.ceil(F.lit(share) * F.sum("own").over(one_key)), F.lit(1))})
    hit = starts.where("before < rank and rank <= before + own").select("key", "range", (F.col("rank") - F.col("before")).alias("rank"))
    same = placed.alias("p").join(hit.alias("h"), F.col("p.key").eqNullSafe(F.col("h.key")) & (F.col("p.range") == F.col("h.range"))).select("p.key", "p.value", "p.n", "h.rank")
    upto = same.withColumn("upto", F.sum("n").over(one_key.orderBy("value")))
    return upto.where("upto - n < rank and rank <= upto").select("key", "value")


def _measures() -> list[Column]:
    """Without any row every measure is 0. The percentile is ``nearest_ranks``'."""
    zero = F.lit(0.0)
    empty = F.count_if(F.col("is_empty_recall"))
    mean = lambda c: F.coalesce(F.avg(c), zero).alias(f"avg_{c}")
    return [
        F.count(F.lit(1)).alias("query_count"), empty.alias("empty_recall_count"), F.coalesce(F.try_divide(empty, F.count(F.lit(1))), zero).alias("empty_recall_rate"),
        mean("total_ms"), mean("embed_ms"), mean("retrieve_ms"), mean("top_score"),
    ]


def within(log: DataFrame, minutes: int | None, now: Column | None = None) -> DataFrame:
    """Rows of the last ``minutes`` before ``now``; all rows without a window."""
    if minutes is None:
        return log
    return log.where(F.col("created_at") >= (F.current_timestamp() if now is None else now) - F.make_interval(mins=F.lit(minutes)))


def metrics(log: DataFrame, minutes: int | None = None, now: Column | None = None, exclude_errors: bool = False) -> DataFrame:
    """One row of measures. Failed queries count like others unless ``exclude_errors``, which asks for ``error_code``."""
    rows = within(log, minutes, now)
    return metrics_by(rows.where("error_code is null") if exclude_errors else rows)


def metrics_by(log: DataFrame, *keys: str) -> DataFrame:
    """The measures for each value of ``keys`` (nulls are a value); without keys one row."""
    key = F.struct(F.lit(0).alias("all"), *keys)
    if keys:
        told = log.groupBy(key.alias("key")).agg(*_measures())
    else:
        told = log.agg(*_measures()).withColumn("key", key)
    ranked = nearest_ranks(log, "total_ms", SHARE, key).withColumnsRenamed({"key": "of", "value": "p95"})
    both = told.join(ranked, told["key"] == ranked["of"], "left")
    return both.select(*(F.col("key")[k].alias(k) for k in keys), *(c for c in told.columns if c != "key"), F.coalesce(F.col("p95").cast("double"), F.lit(0.0)).alias("p95_total_ms"))
