"""Cutting the lineage of iterative plans through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a counted table is broadcast, or numbered in one task.
FEW = 100_000


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in ``spark.checkpoint.dir``; a temporary folder only in local mode without that setting."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        top = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not top and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(top or tempfile.mkdtemp(prefix="graphloom-"))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column | str], n: int, name: str = "pos") -> DataFrame:
    """Adds each row's number, from 1, in a total order; ``n`` is the counted number of rows.

    Few rows are numbered in one task; more are range-partitioned and numbered within the ranges, to which the number
    of rows in the ranges before is added (one row per range goes to the driver).
    """
    if n <= FEW:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    spark = df.sparkSession
    laid = cut(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id()))
    before, rows = 0, []
    for r in laid.groupBy("_range").count().orderBy("_range").collect():
        rows.append((r[0], before))
        before += r[1]
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return laid.join(F.broadcast(spark.createDataFrame(rows, "_range int, _before long")), "_range").withColumn(name, inside + F.col("_before")).drop("_range", "_before")


def small(df: DataFrame, n: int) -> DataFrame:
    """A hint to broadcast a table that has been counted to be small."""
    return F.broadcast(df) if n <= FEW else df


def kept(df: DataFrame, n: int) -> DataFrame:
    """A table that cheap steps derive from a checkpoint, checkpointed too if it has been counted to be large."""
    return df if n <= FEW else cut(df)
