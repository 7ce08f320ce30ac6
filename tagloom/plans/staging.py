"""Session defaults and staged (written) intermediate tables.

A staged table cuts lineage the way ``checkpoint()`` does, but is column-pruned and compressed.  It
goes to the shared folder named by ``spark.checkpoint.dir``; only where a local session has none (tests,
a laptop) a local folder is set, which is removed at the end of the process.  The tables of one
application lie in one folder; ``drop_staged`` removes it when its results have been written.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "tagloom", cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, no UI)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session; a local one only where a session on one machine names none."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_CONF} names no shared folder, and {master} is no local session")
        root = os.environ.get("TAGLOOM_LOCAL_DIR")
        if not root:
            root = tempfile.mkdtemp(prefix="tagloom-")
            atexit.register(shutil.rmtree, root, True)
        root = f"file://{root}"
        spark.conf.set(CHECKPOINT_CONF, root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staged_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a scan of what was written."""
    spark = df.sparkSession
    path = f"{staged_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Removes the staged tables of this application; results that were not written yet can no longer be computed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged_dir(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def few(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that is small by its nature; beyond ``most`` rows an error, never a part of it."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: over {most} rows")
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
