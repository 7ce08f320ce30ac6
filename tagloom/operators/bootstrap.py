"""Paired bootstrap over sentence scores."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.plans.numbering import numbered
from tagloom.plans.staging import stage

#: Resamples of the registered queries, as in the published procedure.
RESAMPLES = 1000
_P = 2147483647
# The portable pseudo-random number as SQL text: integer arithmetic modulo a prime, the same in any
# engine.  Squares keep draws of different salts apart; every product stays below 2^63.
_A = f"((({{x}}) % {_P} * 48271 + {{salt}} * 40692 + 12345) % {_P})"
_B = f"(({_A} * {_A} + {{salt}} * 7919 + 1) % {_P})"
PORTABLE_SQL = f"(({_B} * {_B} + {_A} * 16807) % {_P})"


def portable(x: Column, salt: int) -> Column:
    """A pseudo-random integer below 2^31 - 1 of an integer and a salt."""
    a = (x.cast("long") % _P * 48271 + F.lit(salt * 40692 + 12345)) % _P
    b = (a * a + F.lit(salt * 7919 + 1)) % _P
    return (b * b + a * 16807) % _P


def resampled(pairs: DataFrame, resamples: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, b, diff): mean difference of each resample with replacement, for pairs (by, idx, fa, fb).

    Which row of its group a draw picks depends on (b, k) alone, so the draws of all resamples are spread
    over the cluster and joined by row number; only sums of a resample are combined.
    """
    d = (F.col("fa") - F.col("fb")).alias("d")
    rows = numbered(pairs.select(*by, "idx", d), *by, "idx")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))  # one row for each group
    rows = rows.join(F.broadcast(sizes), list(by)) if by else rows.crossJoin(F.broadcast(sizes))
    rows = stage(rows.select(*by, (F.col("k") - F.col("first")).alias("k"), "n", "d"), "bootstrap-pairs")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = rows.select(*by, "k", "n").repartition(parts).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    picked = draws.select(*by, "b", "n", (portable(F.col("b") * 1000003 + F.col("k"), seed) % F.col("n")).alias("k"))
    return picked.join(rows.select(*by, "k", "d"), [*by, "k"]).groupBy(*by, "b").agg((F.sum("d") / F.max("n")).alias("diff"))


def strict_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx, fa, fb) of two score tables (idx, f1) by place; unequal numbers of rows are an error."""
    n_a, n_b = a.count(), b.count()
    if n_a != n_b:
        raise ValueError(f"paired scores of unequal number: {n_a} and {n_b}")
    left = numbered(a.select("idx", F.col("f1").alias("fa")), "idx")
    return left.join(numbered(b.select(F.col("idx").alias("_idx"), F.col("f1").alias("fb")), "_idx"), "k").select("idx", "fa", "fb")


def index_interval(diffs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Interval by sorted position; one row for each resample."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ordered = diffs.withColumns({"k": F.row_number().over(Window.partitionBy(*by).orderBy("diff")) - 1, "n": n})
    at = lambda q: F.round(F.max(F.when(F.col("k") == F.floor(F.lit(q) * F.col("n")), F.col("diff"))), 6)
    return ordered.groupBy(*by).agg(at(0.025).alias("low"), at(0.975).alias("high"))


def exact_resampled(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """(b, diff) with the legacy generator's stream, which is sequential: one group of two float columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        d = (pdf["fa"] - pdf["fb"]).to_numpy()
        rng = np.random.RandomState(seed)
        return pd.DataFrame({"b": range(resamples), "diff": [float(d[rng.randint(0, len(d), len(d))].mean()) for _ in range(resamples)]})

    return pairs.select("idx", "fa", "fb", F.lit(1).alias("g")).groupBy("g").applyInPandas(run, "b long, diff double")
