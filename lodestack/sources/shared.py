"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Where this process has settled tables, in turn.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of its own where a local session names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestack-"))
    return named or sc.getCheckpointDir()


def own_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/lodestack-{spark.sparkContext.applicationId}"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written there as Parquet and read again: lineage ends there, and what uses it more than once doesn't work it out anew."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Passing:
    """What was settled within it can be dropped before the application ends.

    ``drop`` removes the tables made since it began or since the last call, but the very last one, which must be what has been
    worked out of them; of what it kept before, that goes too. Tables that others made before are left alone.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.begin, self.kept = spark, len(_MADE), None

    def drop(self) -> None:
        gone, self.kept = [*_MADE[self.begin : -1], *filter(None, [self.kept])], _MADE[-1]
        self.begin = len(_MADE)
        for p in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes this application's intermediate tables. Results that haven't been read yet are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
