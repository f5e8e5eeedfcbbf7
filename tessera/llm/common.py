"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id lists are broadcast up to this many rows (8 MB of longs); longer ones are joined by shuffle.
BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine does not name one (unit tests) is a temporary folder set; on a cluster, where
    executors could not see it, that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, row_group: int = 128 << 20) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    row_group: bytes that a writing task gathers in memory; less for tables of large values.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("parquet.block.size", row_group).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named c0, c1, ..., and the new name of each: an operator's own columns, which begin with ``_``, cannot clash."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def unmasked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` under their names, of what became of ``masked(like)``."""
    return df.select(*(f"c{i}" for i in range(len(like.columns)))).toDF(*like.columns)


def among(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids.id`` (``left_anti``: is not); ``df`` may have any columns."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wide, name = masked(df)
    key = ids.select(F.col("id").alias("_id"))
    return unmasked(wide.join(F.broadcast(key) if small else key, F.col(name[column]) == F.col("_id"), how), df)


def bound_batches(spark: SparkSession) -> None:
    """Keep what goes between Spark and Python tasks small: texts may be long, and a default batch of 10,000 of them is not.

    Plans are made when an action runs, so the session keeps these settings; lower ones of the caller stay.
    """
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 8 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
