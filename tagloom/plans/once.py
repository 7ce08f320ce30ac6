"""Rows of one key counted once without moving the rows that are single anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.plans.staging import stage

#: Keys that are sent to all executors at most.
MOST_KEYS = 1_000_000


def once(rows: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """One row for each value of ``key``; only keys are shuffled, and the rows of repeated keys.

    Beyond ``most`` repeated keys all rows are shuffled by their key instead.
    """
    most = MOST_KEYS if most is None else most
    repeated = stage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    if repeated.limit(most + 1).count() > most:
        return rows.dropDuplicates([key])
    keys = F.broadcast(repeated)
    return rows.join(keys, key, "left_anti").unionByName(rows.join(keys, key, "left_semi").dropDuplicates([key]))
