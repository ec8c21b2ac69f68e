"""Running totals over a whole table without bringing it to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope.session import settle

SLICE = "_slice"


def range_slices(df: DataFrame, order: Sequence[Column], slices: int | None, name: str) -> DataFrame:
    """Range-partition by ``order`` and number the partitions, in ascending order."""
    placed = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    return placed.withColumn(name, F.spark_partition_id())


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    value: str,
    running: str = "running",
    position: str = "position",
    total: str = "total",
    slices: int | None = None,
) -> DataFrame:
    """Add the running sum of ``value`` in ``order``, the 1-based position and the grand total.

    ``order`` must rank every row uniquely. The rows are range-partitioned into slices and settled once; each
    slice is summed on its own and shifted by the sum of the slices before it. Only one row per slice is
    ever gathered, and that many are broadcast, so the size is set by ``slices`` and not by the data.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(
        df.repartitionByRange(slices, *order).withColumn(SLICE, F.spark_partition_id())
    )
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shifts = (
        placed.groupBy(SLICE)
        .agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows"))
        .select(
            SLICE,
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_sum").over(everything).alias(total),
        )
    )
    inside = Window.partitionBy(SLICE).orderBy(*order)
    return (
        placed.join(F.broadcast(shifts), SLICE)
        .withColumn(running, F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(position, F.row_number().over(inside))
        .withColumn(running, F.col(running) + F.col("_sum_before"))
        .withColumn(position, F.col(position) + F.col("_rows_before"))
        .drop(SLICE, "_sum_before", "_rows_before")
    )
