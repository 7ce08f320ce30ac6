"""Validation, repair and profiling of tagged examples (idx, lang, sequence, tokens, tags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import bio

EMAIL_PATTERN = r"^[a-z0-9._+-]+@[a-z0-9.-]+\.[a-z]{2,}$"


def unknown_tags(tags: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.array_except(bio.present(tags), bio.known_tags())))


def status(examples: DataFrame) -> DataFrame:
    """Adds ``status`` (the first failed check, or ``valid``), ``unknown``, ``fixes`` and ``fixed_tags``.

    The checks stop at the first failure; a wrong language is looked at last, after the repair.
    """
    tokens, tags = F.col("tokens"), F.col("tags")
    unknown = unknown_tags("tags")
    reached = F.col("status").isin("valid", "non_english")
    return examples.withColumn("unknown", unknown).withColumn(
        "status",
        F.when(F.size(tokens) != F.size(tags), "length_mismatch")
        .when(F.size("unknown") > 0, "unknown_tags")
        .when((F.size(tokens) == 0) | F.exists(tokens, lambda t: t == ""), "empty_token")
        .when(~F.col("lang").eqNullSafe(F.lit("en")), "non_english")
        .otherwise("valid"),
    ).withColumn("fixes", F.when(reached, bio.orphans("tags")).otherwise(F.array().cast("array<int>"))
    ).withColumn("fixed_tags", F.when(reached, bio.repair("tags")).otherwise(tags))


def clean(examples: DataFrame) -> DataFrame:
    """The valid rows, repaired, with the derived columns of the clean table."""
    n_per = bio.count_spans("tags", "PER")
    return (
        status(examples).where("status = 'valid'").select("idx", "lang", "sequence", "tokens", F.col("fixed_tags").alias("tags"))
        .withColumns({"n_tokens": F.size("tokens"), "n_per_spans": n_per, "n_email_spans": bio.count_spans("tags", "EMAIL"), "entity_density_bucket": bio.density_bucket(n_per)})
    )


def verify_strict(examples: DataFrame) -> DataFrame:
    """The rows, unchanged; running it fails on the first orphan and names position, tag and token."""
    at = F.get(bio.orphans("tags"), F.lit(0))
    message = F.concat_ws(" ", F.lit("orphan at"), at.cast("string"), F.get("tags", at), F.lit("token"), F.get("tokens", at), F.lit("idx"), F.col("idx").cast("string"))
    return examples.where(F.when(F.size(bio.orphans("tags")) > 0, F.raise_error(message).isNull()).otherwise(True))


def length_statistics(rows: DataFrame, group: list[str]) -> DataFrame:
    n = F.col("n_tokens")
    return rows.groupBy(*group).agg(
        F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.round(F.avg(n), 2).alias("mean_len"),
        F.percentile(n, F.lit(0.5)).alias("median_len"), F.round(F.percentile(n, F.lit(0.95)), 6).alias("p95_len"),
    )
