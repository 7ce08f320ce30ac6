"""Span errors: one row each, buckets, quotas and annotation sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import bio

#: Fixed order of the buckets.
BUCKETS = ("FN_PER", "FN_EMAIL", "FP_PER", "FP_EMAIL")


def instances(rows: DataFrame) -> DataFrame:
    """(model, idx, error_type, s, e, text) of every missed or invented span; any label but PER counts as EMAIL."""
    kind = lambda x: F.when(x["label"] == "PER", "PER").otherwise("EMAIL")
    side = lambda name, a, b: F.transform(F.array_except(a, b), lambda x: F.struct(F.concat(F.lit(name), kind(x)).alias("error_type"), x["s"].alias("s"), x["e"].alias("e"), bio.span_text("tokens", x).alias("text")))
    errors = F.concat(side("FN_", "gold_spans", "pred_spans"), side("FP_", "pred_spans", "gold_spans"))
    return rows.select("model", "idx", "tokens", F.explode_outer(errors).alias("x")).where("x is not null").select("model", "idx", "tokens", "x.*")


def buckets(errors: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("error_type") == b).alias(b.lower()) for b in BUCKETS]
    return errors.groupBy("model").agg(*counts, F.count(F.lit(1)).alias("total_errors"))


def quotas(errors: DataFrame, most: int = 30) -> DataFrame:
    """(model, error_type, n, quota): shares of ``most``, at least one each, the largest trimmed until they fit.

    Four buckets a model at most, so trimming is a bounded fold over an array.
    """
    n = errors.groupBy("model", "error_type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("model"))
    order = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("error_type")).cast("int")
    first = n.withColumn("quota", F.greatest(F.lit(1), F.bround(F.col("n") / total * most).cast("int"))).withColumn("o", order)
    lists = first.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("o", "error_type", "n", "quota"))).alias("q"))
    total_of = lambda q: F.aggregate(q, F.lit(0), lambda a, x: a + x["quota"])

    def trim(q, _):
        top = F.array_max(F.transform(q, lambda x: x["quota"]))
        at = F.array_min(F.transform(F.filter(q, lambda x: x["quota"] == top), lambda x: x["o"]))
        less = F.transform(q, lambda x: F.struct(x["o"].alias("o"), x["error_type"].alias("error_type"), x["n"].alias("n"), F.when(x["o"] == at, x["quota"] - 1).otherwise(x["quota"]).alias("quota")))
        return F.when((total_of(q) > most) & (top > 1), less).otherwise(q)

    trimmed = F.aggregate(F.sequence(F.lit(1), F.lit(len(BUCKETS))), F.col("q"), trim)
    return lists.select("model", F.explode(trimmed).alias("x")).select("model", "x.error_type", "x.n", "x.quota")


def sampled(errors: DataFrame, rank, most: int = 30) -> DataFrame:
    """The drawn errors: in each bucket the first ``quota`` in the order of ``rank``."""
    order = Window.partitionBy("model", "error_type").orderBy(rank, "idx", "s", "e")
    kept = errors.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)  # a top-k, so the group is never held
    return kept.join(F.broadcast(quotas(errors, most)), ["model", "error_type"]).where(F.col("_r") <= F.col("quota")).drop("_r", "n", "quota")


def sheet(errors: DataFrame) -> DataFrame:
    """Annotation rows."""
    of = lambda side: F.when(F.col("error_type").startswith(side), F.col("text")).otherwise("")
    return errors.select(
        F.col("model").alias("approach"), F.col("idx").alias("sentence_idx"), F.array_join("tokens", " ").alias("tokens"), "error_type",
        of("FN").alias("gold_span"), of("FP").alias("pred_span"), F.lit("MANUAL_TODO").alias("sub_label"), F.lit("").alias("notes"),
    )
