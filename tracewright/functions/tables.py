"""Intermediate tables in the shared folder, and places in an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: About how many rows a task gets that sorts or groups them.
TASK_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a new local one in local mode (as in tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by keys to so many tasks that one gets about TASK_ROWS of its ``rows`` rows (about; not counted here), to every core at least.

    A number of tasks that is left to settings makes tasks that grow with the table; without ``rows`` it is.
    """
    if rows is None:
        return df.repartition(*keys)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the rows of equal keys in one task, for functions that read a task's rows as a stream.

    A repartition by the keys themselves is taken out where the rows below are dealt by them, as those of a union of joins; adaptive execution
    then reads each part of the union in tasks of its own, and a function has no distribution that Spark would keep. No part is dealt by a hash.
    """
    return df.repartition(F.xxhash64(*keys))


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their place in a total order, from 1, without one task that sees them all.

    Rows are dealt by ranges of the order and written, places are counted within a range, and each range begins after the
    rows of those before it (one number a range goes through the driver).
    """
    dealt = written(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), f"{name}-ranges")
    before, starts = 0, []
    for part, n in sorted((r.range_, r["count"]) for r in dealt.groupBy("range_").count().collect()):
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "range_ int, before_ long")
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    got = dealt.withColumn("within_", within).join(offsets, "range_")
    return got.withColumn(name, (F.col("before_") + F.col("within_")).cast("int")).drop("range_", "before_", "within_")
