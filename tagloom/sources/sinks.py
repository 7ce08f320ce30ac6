"""Writers."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.plans.staging import few


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line; the commit protocol publishes the folder as a whole."""
    df.write.mode(mode).json(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; an existing sheet is kept."""
    df.write.mode("ignore").option("emptyValue", "").csv(path, sep="\t", header=True)


def read_sheet(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("emptyValue", "").option("nullValue", "\u0000").csv(path, sep="\t", header=True)


#: A report is a document of a few rows; a longer table is an error here and belongs in ``write_jsonl``.
REPORT_ROWS = 10_000


def write_report(df: DataFrame, path: str) -> dict:
    """A report of a few rows as one JSON array file on any file system, replaced in one step."""
    rows = [r.asDict(recursive=True) for r in few(df, REPORT_ROWS, "report")]
    write_text(df.sparkSession, path, json.dumps(rows, ensure_ascii=False, indent=2, default=str))
    return {"rows": len(rows), "path": path}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file with ``text``; readers see the old content or the new one."""
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs_ = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs_.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs_.delete(target, False)
    fs_.rename(part, target)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each file, read in blocks, so that a file may be larger than memory."""
    for b in batches:
        digests = []
        for path in b["path"]:
            local = path.startswith("file:")
            files, at = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if local else fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with files.open_input_stream(at, compression=None) as f:
                while block := f.read(1 << 22):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pd.DataFrame({"path": b["path"], "digest": digests})


def checksums(spark, path: str, names: str = "*") -> DataFrame:
    """(name, digest, line): SHA-256 of each file and its line of a checksum file; of a folder, the files below it with such names, by their paths from there."""
    # only paths are read here; the contents are read by the tasks
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    folder = f"/{os.path.basename(path.rstrip('/'))}/"
    name = F.when(F.contains("path", F.lit(folder)), F.substring_index("path", folder, -1)).otherwise(F.substring_index("path", "/", -1))  # parts of two tables may share a name
    hashed = files.select("path").mapInPandas(_digests, "path string, digest string")
    return hashed.select(name.alias("name"), "digest", F.concat("digest", F.lit("  "), name).alias("line"))


def write_splits(df: DataFrame, folder: str, column: str = "split") -> None:
    """One Parquet folder for each split."""
    df.write.mode("overwrite").partitionBy(column).parquet(folder)
