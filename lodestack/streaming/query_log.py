"""The query log as a stream: metrics of windows that close, and appending to the stored log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The column that tells by which batch a row of a log came.
BATCH = "batch"


def tumbling(log: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts, empty rate and means for each window of ``created_at``; rows later than ``late`` are left out of closed windows.

    Works on a stream and, where nothing is late, gives the same on a table.
    """
    rows = log.withWatermark("created_at", late) if log.isStreaming else log
    return _told(rows.groupBy(F.window("created_at", width).alias("w")))


def _told(windows: GroupedData) -> DataFrame:
    zero, empty = F.lit(0.0), F.count_if(F.col("is_empty_recall"))
    told = windows.agg(
        F.count(F.lit(1)).alias("query_count"), empty.alias("empty_recall_count"), (empty / F.count(F.lit(1))).alias("empty_recall_rate"),
        F.coalesce(F.avg("total_ms"), zero).alias("avg_total_ms"), F.coalesce(F.max("total_ms").cast("double"), zero).alias("max_total_ms"),
    )
    return told.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *told.columns[1:])


def append_log(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived of a log stream as Parquet and ends; started again, it goes on where it left off.

    A batch is the partition of its number and is written in place of what stands there: one that a failure has run again,
    after it was written or half written, adds nothing. Readers take the table as any Parquet table.
    """

    def written(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn(BATCH, F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)

    return log.writeStream.foreachBatch(written).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trailing(log: DataFrame, checkpoint: str, found: Callable[[DataFrame, int], None], minutes: int = 5, late: str = "10 minutes") -> StreamingQuery:
    """Counts and means of the last ``minutes`` at each full minute, kept in the stream's state: a row counts in as many sliding windows.

    Each batch of windows that changed goes to ``found`` with its number; a window that comes again stands in place of its former row.
    """
    rows = log.withWatermark("created_at", late)
    told = _told(rows.groupBy(F.window("created_at", f"{minutes} minutes", "1 minute").alias("w")))
    return told.writeStream.outputMode("update").foreachBatch(found).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
