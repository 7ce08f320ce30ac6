"""Incremental scoring: a stream of prediction files becomes running span scores.

Files may hold a prediction again, or a later run of it, in any batch.  Each batch adds one narrow row for each
prediction (its time and its span counts, no text); the running scores take the latest run of each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import bio
from tagloom.operators import metrics
from tagloom.plans.staging import shared_dir

PREDICTION = "model string, idx long, tokens array<string>, sequence string, gold_tags array<string>, pred_tags array<string>, run_at timestamp_ntz"
COUNTS = "model string, idx long, run_at timestamp_ntz, counts array<struct<label:string,tp:int,fp:int,fn:int>>, batch int"


def latest(rows: DataFrame, *columns: str) -> DataFrame:
    """The latest run of each (model, idx); of equal times the greatest content, so the order of files does not matter."""
    by = F.struct("run_at", *columns)
    return rows.where("idx is not null").groupBy("model", "idx").agg(F.max_by(F.struct("run_at", *columns), by).alias("r")).select("model", "idx", "r.*")


def counted_stream(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """Prediction files as they come, with the span counts of each row; stateless, so nothing is kept between batches."""
    rows = spark.readStream.schema(PREDICTION).option("maxFilesPerTrigger", files).parquet(path)
    rows = rows.select("model", "idx", "run_at", bio.present("gold_tags").alias("gold"), bio.padded("pred_tags", "gold_tags").alias("pred"))
    spanned = rows.withColumns({"gold_spans": bio.spans("gold"), "pred_spans": bio.spans("pred")})
    return metrics.matched_counts(spanned).select("model", "idx", "run_at", "counts")


def run_incremental(spark: SparkSession, path: str, out: str | None = None, checkpoint: str | None = None) -> str:
    """Scores what is new and stops.  Each batch adds its own rows under its number, so a batch that runs
    again after a failure replaces itself; a later call goes on where the checkpoint ended."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out, checkpoint = out or f"{base}/counts", checkpoint or f"{base}/checkpoint"

    def add(batch: DataFrame, number: int) -> None:
        latest(batch, "counts").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = counted_stream(spark, path).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def running_scores(spark: SparkSession, out: str) -> DataFrame:
    """The scores over all batches so far."""
    rows = latest(spark.read.schema(COUNTS).parquet(out), "counts").select("model", F.explode_outer("counts").alias("c")).where("c is not null").select("model", "c.*")
    return metrics.scored(rows.groupBy("model", "label").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]))
