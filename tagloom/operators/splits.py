"""Splits, permutations and samples by portable draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.bootstrap import portable
from tagloom.plans.numbering import numbered


def stratified(rows: DataFrame, bucket: str, share: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: ceil(n * share) rows are ``val``, spread over the buckets by largest remainder.

    Only the buckets (a handful) go through windows; rows are numbered once over the cluster.
    """
    order = numbered(rows.withColumn("_u", portable(F.col("idx"), seed)), bucket, "_u", "idx")
    sizes = order.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    whole = Window.partitionBy()
    exact = F.col("n") * F.lit(share)
    q = sizes.withColumns({"low": F.floor(exact), "rest": F.round(exact - F.floor(exact), 9)})
    total = F.ceil(F.round(F.sum("n").over(whole) * F.lit(share), 9))
    by_rest = F.row_number().over(Window.orderBy(F.desc("rest"), bucket))
    q = q.withColumn("quota", F.col("low") + (by_rest <= total - F.sum("low").over(whole)).cast("int")).select(bucket, "first", "quota")
    joined = order.join(F.broadcast(q), bucket)
    return joined.withColumn("split", F.when(F.col("k") - F.col("first") < F.col("quota"), "val").otherwise("train")).drop("_u", "k", "first", "quota")


def permuted(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``position``, a permutation of the rows."""
    return numbered(rows.withColumn("_u", portable(F.col("idx"), seed)), "_u", "idx", name="position").drop("_u")


def drawn(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows by the smallest draws."""
    return rows.withColumn("_u", portable(F.col("idx"), seed)).orderBy("_u", "idx").limit(n).drop("_u")
