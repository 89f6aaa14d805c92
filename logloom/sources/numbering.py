"""Sums over all earlier rows of a large table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window


def running_base(table: DataFrame, order: list[str], amount: str, out: str, path: str) -> DataFrame:
    """Write ``table`` to ``path`` in ``order`` and add ``out``, the sum of ``amount`` over all earlier rows.

    Rows are range-partitioned, summed inside each slice, and shifted by the totals of the
    slices before it, so the only unpartitioned window runs over one row per slice.
    """
    spark = table.sparkSession
    (
        table.repartitionByRange(*order)
        .withColumn("_slice", F.spark_partition_id())
        .write.mode("overwrite")
        .parquet(path)
    )
    stored = spark.read.parquet(path)
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        stored.groupBy("_slice")
        .agg(F.sum(amount).alias("_total"))
        .select("_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    )
    return (
        stored.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(F.broadcast(slices), "_slice")  # one row per shuffle partition
        .withColumn(out, F.col("_inside") + F.col("_shift"))
        .drop("_slice", "_inside", "_shift")
    )
