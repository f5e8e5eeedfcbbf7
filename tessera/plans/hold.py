"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder that the context was given. A session of one machine that names none gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str = "held") -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def hold(df: DataFrame, name: str = "held") -> DataFrame:
    """``df``, computed once: written to the shared folder and read back, so that lineage is cut and lost executors cost nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hold_by(df: DataFrame, column: str, name: str = "held") -> DataFrame:
    """``hold``, with a folder for each value of ``column`` (text), so that a filter on it reads those rows alone. Large values are written by several tasks."""
    path = new_folder(df.sparkSession, name)
    df.hint("rebalance", column).write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with numbers from 1 by ``order``, without a window over all rows in one task.

    Rows are dealt by range and numbered inside each; the counts of the ranges, one row each, say where a range begins.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = hold(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(before, "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before")
