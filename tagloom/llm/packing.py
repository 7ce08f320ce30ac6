"""Problem 7: fixed-capacity containers filled with documents.

Sizes are token counts of the public tokenizer.  A document over the capacity is cut into
consecutive pieces, all but the last one full; nothing else is ever split.  The packing is planned
on the histogram of sizes (at most one entry for each size up to the capacity, however many
documents there are): sizes over a third of the capacity are matched greedily, at most two to a
container, each with the largest partner that fits; smaller ones follow in decreasing order into the
tightest gap.  Equal containers are planned as one group, so the plan's size depends on the
capacity only.  Documents then take the places of the plan by their rank among the pieces of their
size, which is sliced, so one size may hold any share of all rows.

Defined cases: null and empty texts have size 0 and lie in container 0 of each limit; a limit
with a null or non-positive capacity gets no containers; an empty table gives no rows; ids are
expected to be unique.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.bpe import token_counts
from tagloom.llm.ranking import ranked
from tagloom.plans.staging import few, stage, table


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Groups of equal containers: (number of containers, size -> items of that size in each)."""
    left = {s: n for s, n in counts.items() if n > 0}
    large = sorted(s for s in left if s * 3 > capacity)
    small = sorted((s for s in left if s * 3 <= capacity), reverse=True)
    by_gap: dict[int, list[list]] = defaultdict(list)
    gaps: list[int] = []

    def put(number: int, items: dict[int, int], gap: int) -> None:
        if gap not in by_gap or not by_gap[gap]:
            i = bisect_left(gaps, gap)
            if i == len(gaps) or gaps[i] != gap:
                insort(gaps, gap)
        by_gap[gap].append([number, items])

    while large:
        a = large[-1]
        n = left[a]
        i = bisect_left(large, capacity - a + 1) - 1
        if i < 0:
            put(n, {a: 1}, capacity - a)
            large.pop()
            continue
        b = large[i]
        if a == b:
            if n // 2:
                put(n // 2, {a: 2}, capacity - 2 * a)
            large.pop()
            if n % 2:
                j = bisect_left(large, capacity - a + 1) - 1
                if j >= 0:
                    put(1, {a: 1, large[j]: 1}, capacity - a - large[j])
                    left[large[j]] -= 1
                    if not left[large[j]]:
                        large.pop(j)
                else:
                    put(1, {a: 1}, capacity - a)
            continue
        m = min(n, left[b])
        put(m, {a: 1, b: 1}, capacity - a - b)
        left[a] -= m
        left[b] -= m
        if not left[b]:
            large.pop(i)
        if not left[a]:
            large.pop()
    for s in small:
        n = left[s]
        while n:
            i = bisect_left(gaps, s)
            if i == len(gaps):
                each = capacity // s
                if n >= each:
                    put(n // each, {s: each}, capacity - s * each)
                    n %= each
                else:
                    put(1, {s: n}, capacity - s * n)
                    n = 0
                continue
            gap = gaps[i]
            number, items = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(i)
            each = gap // s
            full = min(number, n // each)
            if full:
                put(full, items | {s: items.get(s, 0) + each}, gap - s * each)
                n -= full * each
            rest = number - full
            if rest and n:  # fewer than ``each`` are left
                put(1, items | {s: items.get(s, 0) + n}, gap - s * n)
                n, rest = 0, rest - 1
            if rest:
                put(rest, items, gap)
    return [(number, items) for groups in by_gap.values() for number, items in groups]


def places(groups: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """(size, start, each, first): ranks from ``start`` on go, ``each`` to a container, into the containers from ``first`` on."""
    taken: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for number, items in groups:
        for size, each in sorted(items.items()):
            rows.append((size, taken[size], each, first))
            taken[size] += number * each
        first += number
    return pd.DataFrame(rows, columns=["size", "start", "each", "first"]).sort_values(["size", "start"], ignore_index=True).astype("int64")


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, start_token, size) of documents (doc_id, n_tokens)."""
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int") - 1, F.lit(0))
    return sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        "doc_id", "piece_no", (F.col("piece_no") * capacity).alias("start_token"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).alias("size"),
    )


def _place(table_: pd.DataFrame):
    size, start, each, first = (table_[c].to_numpy() for c in ("size", "start", "each", "first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = np.searchsorted(size, np.arange(int(size.max(initial=0)) + 2))
        for b in batches:
            s, r = b["size"].to_numpy(), b["rank"].to_numpy()
            at = np.empty(len(b), np.int64)
            for v in np.unique(s):
                mine = s == v
                at[mine] = low[v] + np.searchsorted(start[low[v] : low[v + 1]], r[mine], side="right") - 1
            yield pd.DataFrame({
                "container_id": first[at] + (r - start[at]) // each[at], "doc_id": b["doc_id"], "piece_no": b["piece_no"],
                "start_token": b["start_token"], "n_tokens": b["size"],
            })

    return run


PACKED = "container_id long, doc_id long, piece_no int, start_token int, n_tokens int"


#: Pieces of one size that are ranked together; a size with more is cut into slices.
SLICE_ROWS = 100_000
LIMITS = 1000


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """(container_id, doc_id, piece_no, start_token, n_tokens) for documents (doc_id, n_tokens)."""
    items = pieces(sizes, capacity)
    histogram = items.where("size > 0").groupBy("size").count().toPandas()  # at most ``capacity`` rows
    counts = dict(zip(histogram["size"].tolist(), histogram["count"].tolist()))
    where = places(plan(counts, capacity))
    slices = F.from_json(F.lit(str([-(-counts.get(s, 1) // SLICE_ROWS) for s in range(max(counts, default=0) + 1)])), "array<int>")
    placed = ranked(items.where("size > 0"), ["size"], ["doc_id", "piece_no"], F.get(slices, F.col("size"))).mapInPandas(_place(where), PACKED)
    empty = items.where("size = 0").select(F.lit(0).cast("long").alias("container_id"), "doc_id", "piece_no", "start_token", F.col("size").alias("n_tokens"))
    return placed.unionByName(empty)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(limit_name, container_id, doc_id, piece_no, start_token, n_tokens) of every document under every limit."""
    sizes = stage(token_counts(table(spark, sf_dir, "documents")), "p7-sizes")
    limits = few(table(spark, sf_dir, "pack_limits").where("capacity_tokens > 0").orderBy("limit_name"), LIMITS, "limits")  # each is a plan of its own
    parts = [pack(sizes, r["capacity_tokens"]).select(F.lit(r["limit_name"]).alias("limit_name"), "*") for r in limits]
    if not parts:
        return spark.createDataFrame([], f"limit_name string, {PACKED}")
    return reduce(DataFrame.unionByName, parts)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(limit_name, containers, tokens, unused_share, least_containers) of each limit; no packing needs fewer than ``least_containers``."""
    capacity = table(spark, sf_dir, "pack_limits")
    used = p7_packed(spark, sf_dir).groupBy("limit_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    unused = 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers")
    return used.join(capacity, "limit_name").select("limit_name", "containers", "tokens", F.round(unused, 6).alias("unused_share"), least)


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(limit_name, documents, pieces, over_capacity, wrong_pieces, gaps): each document lies whole in the containers of each limit.

    ``over_capacity`` containers hold too much, ``wrong_pieces`` are pieces of a divided document that are no full ones but
    the last, ``gaps`` are documents whose pieces do not follow each other; all three are 0.
    """
    packed = stage(p7_packed(spark, sf_dir), "p7-packed").join(table(spark, sf_dir, "pack_limits"), "limit_name")
    over = packed.groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("n"), F.max("capacity_tokens").alias("c")).groupBy("limit_name").agg(F.count_if(F.col("n") > F.col("c")).alias("over_capacity"))
    # the pieces of a document are k full ones and a last one, so their starts and sizes are those of 0 .. k
    full = (F.col("n_tokens") != F.col("capacity_tokens")).cast("int")
    docs = packed.groupBy("limit_name", "doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.max("piece_no").alias("last"), F.sum(full).alias("odd"), F.sum(F.col("start_token") - F.col("piece_no") * F.col("capacity_tokens")).alias("off"), F.countDistinct("piece_no").alias("numbers"),
    )
    per = docs.groupBy("limit_name").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("pieces").alias("pieces"), F.count_if(F.col("odd") > 1).alias("wrong_pieces"),
        F.count_if((F.col("off") != 0) | (F.col("last") + 1 != F.col("pieces")) | (F.col("numbers") != F.col("pieces"))).alias("gaps"),
    )
    return per.join(over, "limit_name")
