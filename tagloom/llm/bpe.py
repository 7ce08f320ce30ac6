"""Problem 6: byte-level BPE of a whole corpus inside the JVM.

Words are cut by the tokenizer's public pattern.  Ranked merges are folded with higher-order
functions over the byte pieces (hex pairs) of each distinct word, with the ranks as one literal
map, split into buckets because Spark scans a map from its start.  The encodings of the most
frequent words become a second literal; a document looks its words up there and folds the rest in
place, so the documents themselves are never shuffled and are read twice: for the words and for the ids.

The fold is quadratic in the length of one word.  Words of ``LONG_WORD`` characters and more are merged by the
same ranks with a heap, in Arrow batches that hold these words only; the ranks travel there as a broadcast.

Defined cases: a null and an empty text have the empty list.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the public pattern of the tokenizer.  ``\s`` is spelled out, for Java's is ASCII only.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Words from this length on are merged with a heap instead of the fold; the ids are the same.
LONG_WORD = 256
RANK_BUCKETS = 16384
#: The cache of encoded words: a bound on what a task carries, not on what is encoded.
CACHE_WORDS = 65536
CACHE_BUCKETS = 16384


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Piece -> rank (which is also its id) of a public rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def _literal(value: object, schema: str) -> Column:
    """A nested literal; the optimizer folds it once per query."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), schema)


def _find(buckets: Column, at: Column, key: Column) -> Column:
    return F.try_element_at(F.get(buckets, at), key)


def _rank(ranks: Column, piece: Column) -> Column:
    return _find(ranks, (F.crc32(piece) % RANK_BUCKETS).cast("int"), piece)


def _cache_bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(CACHE_BUCKETS))


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The literal rank map: hex of a piece -> rank."""
    buckets: list[dict] = [{} for _ in range(RANK_BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        buckets[zlib.crc32(key.encode()) % RANK_BUCKETS][key] = rank
    return _literal(buckets, "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, ranks: Column) -> Column:
    """Ids of one word: repeatedly join the adjacent pieces of lowest rank."""
    hexed = F.hex(F.encode(word, "UTF-8"))
    pieces = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.substring(hexed, i, F.lit(2)))

    def merge(state: Column, _: Column) -> Column:
        acc = state["p"]
        pair_ranks = F.transform(
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
            lambda piece, i: _rank(ranks, F.concat(piece, F.get(acc, i + 1))),
        )

        def join(r: Column) -> Column:
            best = F.array_min(r)
            at = F.array_position(r, best).cast("int")
            joined = F.concat(
                F.slice(acc, F.lit(1), at - 1),
                F.array(F.concat(F.get(acc, at - 1), F.get(acc, at))),
                F.slice(acc, at + 2, F.size(acc)),
            )
            return F.when(best.isNull(), F.struct(acc.alias("p"), F.lit(True).alias("done"))).otherwise(
                F.struct(joined.alias("p"), (F.size(joined) < 2).alias("done"))
            )

        return F.when(state["done"], state).otherwise(_let(pair_ranks, join))

    folded = F.aggregate(
        F.sequence(F.lit(1), F.octet_length(word)),
        F.struct(pieces.alias("p"), (F.octet_length(word) < 2).alias("done")),
        merge,
        lambda state: F.transform(state["p"], lambda piece: _rank(ranks, piece)),
    )
    whole = _rank(ranks, hexed)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(folded)


def words_of(text: Column) -> Column:
    """The words of a text in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def has_long_run(text: Column) -> Column:
    """Whether a word of ``LONG_WORD`` characters is possible: a stretch without a plain blank, or one of blanks alone."""
    stretch = F.exists(F.split(text, " "), lambda x: F.length(x) >= LONG_WORD - 1) | F.contains(text, F.lit(" " * (LONG_WORD - 1)))
    return (F.length(text) >= LONG_WORD) & stretch


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by ranked merges with a heap: the pair of lowest rank first, the leftmost of equal ones."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # where the piece that starts here ends; 0 where none starts
    before = list(range(-1, n - 1))  # the start of the piece before
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two pieces has changed
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            r = ranks.get(word[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0:
            r = ranks.get(word[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


def _long_words(ranks):
    """A function of an array of words: the ids of each; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if x is None else [merged(w.encode("utf-8"), ranks.value) for w in x] for x in b], dtype="object")

    return F.pandas_udf(run, "array<array<int>>")


def _cached_words(docs: DataFrame, ranks: Column, counts: bool, cache_words: int) -> tuple[Column, bool]:
    """The literal cache of the most frequent words of all documents; ties by the word."""
    top = (
        docs.select(F.explode_outer(words_of(F.col("text"))).alias("word")).where((F.col("word") != "") & (F.length("word") < LONG_WORD))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(cache_words)
        .select("word")
    )
    ids = _let(ranks, lambda r: fold_merges(F.col("word"), r))
    parts = docs.sparkSession.sparkContext.defaultParallelism
    rows = top.repartition(parts).select("word", _cache_bucket(F.col("word")).alias("at"), ids.alias("ids")).collect()
    cache: list[dict] = [{} for _ in range(CACHE_BUCKETS)]
    for r in rows:
        cache[r["at"]][r["word"]] = len(r["ids"]) if counts else r["ids"]
    return _literal(cache, f"array<map<string,{'int' if counts else 'array<int>'}>>"), bool(rows)


def _encode(docs: DataFrame, key: str, text: str, path: str, counts: bool, cache_words: int) -> DataFrame:
    table_ = read_ranks(path)
    ranks = rank_literal(table_)
    docs = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cache, any_word = _cached_words(docs, ranks, counts, cache_words)
    is_long = lambda w: F.length(w) >= LONG_WORD
    long_words = F.when(has_long_run(F.col("text")), F.array_distinct(F.filter(words_of(F.col("text")), is_long)))
    docs = docs.withColumn("_long", long_words)
    docs = docs.withColumn("_merged", _long_words(docs.sparkSession.sparkContext.broadcast(table_))("_long"))
    kind = "int" if counts else "array<int>"

    def one(word: Column, r: Column, known: Column) -> Column:
        size = (lambda ids: F.size(ids)) if counts else (lambda ids: ids)
        ids = size(fold_merges(word, r))
        if any_word:
            ids = F.coalesce(_find(cache, _cache_bucket(word), word), ids)
        return F.when(is_long(word), size(F.get(known["ids"], F.array_position(known["words"], word).cast("int") - 1))).otherwise(ids)

    both = F.struct(F.col("_long").alias("words"), F.col("_merged").alias("ids"))
    each = _let(ranks, lambda r: _let(both, lambda known: F.transform(words_of(F.col("text")), lambda word: one(word, r, known))))
    done = F.aggregate(each, F.lit(0), lambda a, x: a + x) if counts else F.flatten(each)
    return docs.select(key, F.when(F.col("text") == "", F.lit(0) if counts else F.array().cast(kind)).otherwise(done).alias("out"))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(key, ids): each text as its list of ids, without special tokens."""
    return _encode(docs, key, text, path, False, cache_words).withColumnRenamed("out", "ids")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(key, n_tokens): the number of ids of each text, by the same fold."""
    return _encode(docs, key, text, path, True, cache_words).withColumnRenamed("out", "n_tokens")


def decode(encoded: DataFrame, key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(key, text): concatenates the binary pieces of the ids."""
    ranks = read_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    table = _literal(pieces, "array<string>")
    hexed = F.array_join(F.transform(F.col("ids"), lambda i: F.get(table, i)), "")
    return encoded.select(key, F.decode(F.unhex(hexed), "UTF-8").alias("text"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document by ``byte_bpe_50k``."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of every document, encoded and decoded again; a null text comes back empty."""
    return decode(p6_ids(spark, sf_dir))


def p6_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(documents, chars, long_documents, long_words, long_chars): how much of the corpus lies in words of ``LONG_WORD`` characters and more."""
    text = F.coalesce("text", F.lit(""))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.length(text).alias("n"), F.when(has_long_run(text), F.filter(words_of(text), lambda w: F.length(w) >= LONG_WORD)).alias("w"))
    return rows.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chars"), F.count_if(F.size("w") > 0).alias("long_documents"),
        F.coalesce(F.sum(F.when(F.col("w").isNotNull(), F.size("w"))), F.lit(0)).alias("long_words"), F.coalesce(F.sum(F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x))), F.lit(0)).alias("long_chars"),
    )
