"""Answers of a backend in steps that survive a failure: what has been answered is never asked again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import responses

EVERY = 50


def answer_resumably(rows: DataFrame, backend: responses.Backend, path: str, every: int = EVERY, files: int | None = None) -> DataFrame:
    """Adds ``raw_response`` to ``rows`` (with a column ``prompt``), with a checkpoint after each step.

    The open rows are written once to ``path`` in files of at most ``every`` rows; a stream answers ``files`` of them a step
    (one for each core by default) and commits each step.  A second call with the same ``path`` goes on behind the last
    committed step; a step that broke off replaces itself.
    """
    spark = rows.sparkSession
    todo, out = f"{path}/todo", f"{path}/answers"
    rows.write.mode("ignore").option("maxRecordsPerFile", every).parquet(todo)
    files = files or spark.sparkContext.defaultParallelism
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(todo)

    def step(batch: DataFrame, number: int) -> None:
        responses.answered(batch, backend).write.mode("overwrite").parquet(f"{out}/step={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    answered = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", raw_response string, step int")
    return answered.parquet(out).drop("step") if _exists(spark, out) else rows.withColumn("raw_response", F.lit(None).cast("string")).where(F.lit(False))


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
