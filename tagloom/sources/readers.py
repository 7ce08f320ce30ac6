"""Readers.  Schemas are declared, and every relation carries an explicit row id."""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

EXAMPLE = "lang string, sequence string, tokens array<string>, ner_tags array<string>"


def read_json_array(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """One JSON array a file; the position in the array is ``idx``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{_typed(schema)}>>")).alias("idx", "r")).select(F.col("idx").cast("long").alias("idx"), "r.*")


def _typed(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on a malformed line; blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines drop out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_jsonl_split(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines with ``file`` and ``line_no`` from 1); blank lines count as lines and are neither.

    Files are split among tasks; a line's number is its place in its block plus the lines of the blocks before, so only
    one row for each block goes through a window.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    parsed = lines.where(F.trim("value") != "").select("*", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}).alias("r"))
    is_bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bad = parsed.where(is_bad).select("file", "block", "at", F.col("value").alias("line")).join(blocks.withColumn("before", before), ["file", "block"])
    return parsed.where(~is_bad).select("r.*").drop("_corrupt_record"), bad.select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_no"), "line")


def warn_malformed(bad: DataFrame, shown: int = 20) -> int:
    """Logs how many lines are malformed and the first ``shown`` of them; returns the number."""
    n = bad.count()
    if n:
        log.warning("%d malformed lines", n)
        for r in bad.orderBy("file", "line_no").limit(shown).collect():
            log.warning("%s:%d: %s", r.file, r.line_no, r.line[:200])
    return n


def read_any_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``.jsonl`` line by line, ``.json`` as one array; anything else is an error."""
    if path.endswith(".jsonl"):
        return read_jsonl_lenient(spark, path, schema)
    if path.endswith(".json"):
        return read_json_array(spark, path, schema)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def read_discovered(spark: SparkSession, folder: str, schema: str, suffix: str = "_predictions") -> DataFrame:
    """All prediction folders or files ``<model><suffix>*`` below a folder, with the model from the path."""
    rows = spark.read.schema(schema).json(f"{folder}/*{suffix}*", mode="DROPMALFORMED")
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+?){suffix}[^/]*(?:/[^/]+)?$", 1)
    return rows.select(name.alias("model"), "*")


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, on any file system; an error names them all."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError("none of: " + ", ".join(paths))


def require(spark: SparkSession, *paths: str) -> None:
    """Fails naming every missing path."""
    missing = []
    for path in paths:
        try:
            first_existing(spark, path)
        except FileNotFoundError:
            missing.append(path)
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))


def read_records(spark: SparkSession, *paths: str, schema: str = EXAMPLE) -> DataFrame:
    """A fallback chain: the first path that exists, Parquet or JSON lines."""
    path = first_existing(spark, *paths)
    return read_jsonl_lenient(spark, path, schema) if path.rstrip("/").endswith(".jsonl") else spark.read.parquet(path)


def read_config(path: str) -> dict:
    """A JSON or (flat ``key: value``) YAML file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        pairs = (line.split(":", 1) for line in text.splitlines() if ":" in line and not line.startswith((" ", "#")))
        return {k.strip(): v.strip() for k, v in pairs}


def paths_of(folder: str) -> dict[str, str]:
    """The output bundle of a cross-domain run."""
    return {k: os.path.join(folder, v) for k, v in {"data": "data.parquet", "predictions": "predictions", "summary": "eval_summary.json", "stats": "data_stats.json"}.items()}
