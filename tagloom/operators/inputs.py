"""The engine's relations, read from a data folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import bio
from tagloom.plans.staging import table

SPLITS = {"train": "train_injected", "val": "val_injected", "test": "test_injected"}


def examples(spark: SparkSession, sf_dir: str, split: str = "train") -> DataFrame:
    """(idx, lang, sequence, tokens, tags) of a split, each id once; null arrays are empty."""
    return (
        table(spark, sf_dir, SPLITS[split]).where("idx is not null").dropDuplicates(["idx"])
        .select("idx", "lang", "sequence", bio.present("tokens").alias("tokens"), bio.present("ner_tags").alias("tags"))
    )


def all_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (examples(spark, sf_dir, s).withColumn("split", F.lit(s)) for s in SPLITS))


TAGS, TEXT = ("gold_tags", "pred_tags"), ("tokens", "sequence")


def encoder_predictions(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = (*TEXT, *TAGS)) -> DataFrame:
    """The latest run of each (model, idx) with the columns asked for, one without a time only where there is no other;
    combined before the shuffle, no window."""
    rows = table(spark, sf_dir, "encoder_predictions").where("idx is not null")
    return rows.groupBy("model", "idx").agg(F.max_by(F.struct(*columns), F.struct("run_at")).alias("r")).select("model", "idx", "r.*")


def llm_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "llm_predictions").where("idx is not null").dropDuplicates(["idx"])


def predictions(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """The canonical relation (model, idx, gold, pred, raw_pred), ``pred`` padded to ``gold``; with ``text`` also tokens and sequence.

    Scores of tags leave the text out, so it is neither read nor shuffled.
    """
    columns = (*TEXT, *TAGS) if text else TAGS
    llm = llm_predictions(spark, sf_dir).withColumnsRenamed({"ner_tags": "gold_tags", "predicted_tags": "pred_tags"}).select(F.lit("llm").alias("model"), "idx", *columns)
    both = encoder_predictions(spark, sf_dir, columns).unionByName(llm)
    texts = [bio.present("tokens").alias("tokens"), F.col("sequence")] if text else []
    return both.select("model", "idx", *texts, bio.present("gold_tags").alias("gold"), bio.padded("pred_tags", "gold_tags").alias("pred"), F.col("pred_tags").alias("raw_pred"))


def spanned(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """``predictions`` with the span arrays of both sides."""
    return predictions(spark, sf_dir, text).withColumns({"gold_spans": bio.spans("gold"), "pred_spans": bio.spans("pred")})
