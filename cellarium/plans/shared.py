"""Cutting lineage, and deciding what is small enough to broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A table of at most so many narrow rows may be broadcast.
SMALL_ROWS = 200_000


def settle(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder of spark.checkpoint.dir. Where that is unset, as in tests, a temporary folder is used."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="cellarium-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int | None) -> DataFrame:
    """df, marked for broadcast if it is known to have at most SMALL_ROWS rows."""
    return F.broadcast(df) if rows is not None and rows <= SMALL_ROWS else df


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with n, their place (from 0) in a total order: range partitions are counted, then rows within each."""
    keys = [f"__o{i}" for i in range(len(order))]
    parts = settle(rows.withColumns(dict(zip(keys, order))).repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()))
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    base = counts.select("__p", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    own = Window.partitionBy("__p").orderBy(*keys)
    return parts.join(F.broadcast(base), "__p").withColumn("n", F.col("b") + F.row_number().over(own) - 1).drop("__p", "b", *keys)
