"""Running totals over a global order, without bringing the rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.storage import cut


def running_totals(df: DataFrame, order: list[Column], amount: str, start: str = "_start", row: str = "_row") -> DataFrame:
    """Add `start`, the sum of `amount` over all rows before this one, and `row`, their count, in the given order.

    Rows are range-partitioned, each partition is numbered on its own, and the exclusive prefix sums of the
    per-partition totals (one row per partition) shift the local numbers. Rows that tie on the whole order are spread by
    their input position, so a key that holds a third of all rows still goes to many partitions. The ranged rows are
    checkpointed: both uses below must see the same partition bounds. An empty input gives an empty output.
    """
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, F.col("_tie"))
        .withColumn("_part", F.spark_partition_id())
    )
    ranged = cut(ranged)
    totals = ranged.groupBy("_part").agg(F.sum(amount).alias("_sum"), F.count(F.lit(1)).alias("_count"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        "_part",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_count_before"),
    )
    here = Window.partitionBy("_part").orderBy(*order, "_tie")
    return (
        ranged.withColumn("_local", F.coalesce(F.sum(amount).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_local_row", F.row_number().over(here) - 1)
        .join(shifts, "_part")
        .withColumn(start, (F.col("_sum_before") + F.col("_local")).cast("long"))
        .withColumn(row, (F.col("_count_before") + F.col("_local_row")).cast("long"))
        .drop("_part", "_sum_before", "_count_before", "_local", "_local_row", "_tie")
    )
