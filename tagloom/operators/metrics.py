"""Scores of predictions.  Spans are matched inside each row, so a metric is one partial aggregate and one small shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import bio


def of_label(spans: str, label: str) -> Column:
    return F.filter(F.col(spans), lambda x: x["label"] == F.lit(label))


def matched_counts(rows: DataFrame) -> DataFrame:
    """Adds for each row ``counts``: (label, tp, fp, fn) for every label of either side."""
    labels = F.array_distinct(F.concat(F.transform("gold_spans", lambda x: x["label"]), F.transform("pred_spans", lambda x: x["label"])))
    hit = F.array_intersect("gold_spans", "pred_spans")
    n = lambda a, label: F.size(F.filter(a, lambda x: x["label"] == label))
    return rows.withColumn("hit", hit).withColumn("counts", F.transform(labels, lambda label: F.struct(
        label.alias("label"), n(F.col("hit"), label).alias("tp"),
        (n(F.col("pred_spans"), label) - n(F.col("hit"), label)).alias("fp"), (n(F.col("gold_spans"), label) - n(F.col("hit"), label)).alias("fn"),
    ))).drop("hit")


def span_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, tp, fp, fn) with strict matching."""
    # the outer form, for the inner one puts a filter with a copy of the whole expression below the projection
    each = matched_counts(rows).select(*by, F.explode_outer("counts").alias("c")).where("c is not null").select(*by, "c.*")
    return each.groupBy(*by, "label").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])


def scored(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": bio.ratio(tp, tp + fp), "recall": bio.ratio(tp, tp + fn), "f1": bio.f1(tp, fp, fn)})


def token_counts(rows: DataFrame, by: list[str], of) -> DataFrame:
    """(by, tp, fp, fn, tn) of the tokens for which ``of(tag)`` holds on either side; gold and pred have one length."""
    n = lambda test: F.sum(F.size(F.filter(F.arrays_zip("gold", "pred"), test)))
    return rows.groupBy(*by).agg(
        n(lambda x: of(x["gold"]) & of(x["pred"])).alias("tp"), n(lambda x: ~of(x["gold"]) & of(x["pred"])).alias("fp"),
        n(lambda x: of(x["gold"]) & ~of(x["pred"])).alias("fn"), n(lambda x: ~of(x["gold"]) & ~of(x["pred"])).alias("tn"),
    )


def token_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": bio.ratio(tp, tp + fp), "recall": bio.ratio(tp, tp + fn), "f1": bio.f1(tp, fp, fn), "fpr": bio.ratio(fp, fp + tn), "fnr": bio.ratio(fn, fn + tp)})


def macro(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def sentence_f1(rows: DataFrame) -> DataFrame:
    """Adds ``f1``: the mean over the types present, 0 where neither side has a span."""
    each = matched_counts(rows)
    score = F.transform("counts", lambda c: F.coalesce(F.try_divide(2.0 * c["tp"], 2.0 * c["tp"] + c["fp"] + c["fn"]), F.lit(0.0)))
    total = F.aggregate(score, F.lit(0.0), lambda a, x: a + x)
    return each.withColumn("f1", F.when(F.size("counts") > 0, total / F.size("counts")).otherwise(F.lit(0.0))).drop("counts")


def late_sentence_f1(rows: DataFrame) -> DataFrame:
    """``sentence_f1`` with the spans of ``late_spans``."""
    both = lambda c: F.concat(bio.late_spans(c, "PER"), bio.late_spans(c, "EMAIL"))
    return sentence_f1(rows.withColumns({"gold_spans": both("gold"), "pred_spans": both("pred")}))


def leaked_spans(rows: DataFrame) -> DataFrame:
    """Adds ``leaked``: gold spans with a token predicted ``O``."""
    return rows.withColumn("leaked", F.size(F.filter("gold_spans", lambda x: F.exists(F.slice("pred", x["s"] + 1, x["e"] - x["s"]), lambda t: t == "O"))))
