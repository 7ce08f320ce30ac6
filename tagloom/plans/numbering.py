"""Global row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.plans.staging import stage


def numbered(rows: DataFrame, *order: str, name: str = "k") -> DataFrame:
    """Adds a dense number from 0 in the order given (which should be total).

    Rows are range-partitioned and sorted once and written with their place in their partition; only
    one offset for each partition goes through a window.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    parts = stage(parts.withColumn("_k", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)), "numbered")
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_o")
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_k") + F.col("_o")).drop("_p", "_k", "_o")
