"""Bitmaps of fixed size over hashes: filters that let all rows with a wanted key pass and few others, ahead of an exact join."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one block when a bitmap is put together by the cluster.
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS


def packed(places: DataFrame, bits: int, probes: int = 1) -> np.ndarray:
    """The bitmap of the column ``at`` (from 0 to ``bits``), eight places a byte; at most ``bits / 8`` bytes come to the driver.

    With more ``probes``, ``at`` is the number of a block over that many places in it.
    """

    def pack(key: tuple, at: pd.DataFrame) -> pd.DataFrame:
        block, keys = np.zeros(BLOCK, bool), at["at"].to_numpy(np.int64)
        for k in range(probes):
            block[keys >> BLOCK_BITS * k & BLOCK - 1] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(block, bitorder="little").tobytes()]})

    number = F.shiftright(F.col("at").cast("long"), BLOCK_BITS * probes).cast("int")
    blocks = places.select("at").distinct().withColumn("block", number).groupBy("block").applyInPandas(pack, "block int, bits binary")
    out = np.zeros(max(bits, BLOCK) // 8, np.uint8)
    for r in blocks.collect():
        out[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def hash_filter(keys: DataFrame, name: str, bits: int = 1 << 16, stored: bool = False) -> Callable[[Column], Column]:
    """A test whether a value may be among the values of ``keys[name]``; it runs in the JVM, with the bitmap as a literal.

    A literal stands in every text of the plan that the driver makes and keeps.  A ``stored`` bitmap of over ``BLOCK`` bits is the
    result of a scalar subquery instead, which no text of a plan has; it can't stand in the function of a higher-order function.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    found = packed(keys.select(at(F.col(name)).alias("at")), bits)[: bits // 8]
    if bits <= BLOCK:  # small enough for one value a place, so the hash is computed once
        flags = F.from_json(F.lit("[" + ",".join(np.unpackbits(found, bitorder="little").astype(str)) + "]"), "array<tinyint>")
        return lambda c: F.get(flags, at(c).cast("int")) == 1
    if stored:
        table = keys.sparkSession.createDataFrame([(found.view("<i8").tolist(),)], "bits array<bigint>").scalar()
    else:
        table = F.from_json(F.lit(str(found.view("<i8").tolist())), "array<bigint>")
    return lambda c: F.getbit(F.get(table, F.floor(at(c) / 64).cast("int")), F.pmod(at(c), F.lit(64)).cast("int")) == 1
