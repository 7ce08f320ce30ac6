"""Dense ranks inside groups that may be very large.

A group is cut into slices by a permuted hash of the id; slice sizes give offsets, and only rows of
one slice are sorted together, so no task ever holds a whole group.  ``slices`` is a number or, where the
sizes of the groups are known, a column that gives large groups more slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 1024


def permuted(seed: list[Column], ids: list[Column]) -> Column:
    """A pseudo-random 64-bit value for each id."""
    return F.xxhash64(F.lit(20240101), *seed, *ids)


def ranked(rows: DataFrame, by: list[str], ids: list[str], slices: int | Column = SLICES, name: str = "rank") -> DataFrame:
    """``rows`` with a rank from 0 in each group of ``by``, in the permuted order of ``ids``; null groups are groups."""
    order = permuted([F.col(c) for c in by], [F.col(c) for c in ids])
    rows = rows.withColumn("_order", order).withColumn("_slice", F.shiftrightunsigned("_order", 40).cast("int") % slices)
    keys = [*by, "_slice"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("_order", *ids))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in keys]
    numbered = rows.withColumn("_inside", inside - 1).alias("r").join(offsets.alias("o"), same)
    return numbered.select(*[F.col(f"r.{c}") for c in rows.columns if not c.startswith("_")], (F.col("_inside") + F.col("_before")).alias(name))
