"""Labels of subwords.  A splitter gives each row its ``word_ids``; -1 marks special pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import bio

MAX_PIECES = 256
#: A public tokenizer; the file is a parameter.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def chunk_word_ids(tokens: Column | str, size: int = 4) -> Column:
    """The built-in splitter: pieces of ``size`` characters, between two special pieces."""
    special = F.array(F.lit(-1))
    parts = F.transform(bio.present(tokens), lambda t, i: F.array_repeat(i, F.greatest(F.ceil(F.length(t) / size), F.lit(1)).cast("int")))
    return F.concat(special, F.flatten(parts), special)


def tokenizer_word_ids(spark: SparkSession, path: str = TOKENIZER, size: int = MAX_PIECES):
    """A function of a token array: the word of each piece of a tokenizer file, at most ``size`` pieces with the two special
    ones, in Arrow batches; None without the file or the library.  The file travels to the executors as a broadcast."""
    try:
        from tokenizers import Tokenizer  # noqa: F401

        with open(path, "rb") as f:
            blob = spark.sparkContext.broadcast(f.read())
    except (ImportError, OSError):
        return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(blob.value)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        for b in batches:
            words = [[w or "" for w in ([] if x is None else x)] for x in b]
            each = tokenizer.encode_batch(words, is_pretokenized=True, add_special_tokens=False)
            yield pd.Series([[-1, *e.word_ids[: size - 2], -1] for e in each])

    return F.pandas_udf(run, "array<int>")


def aligned_labels(word_ids: Column | str, tags: Column | str) -> Column:
    """First piece: the word's label; later pieces: ``I-X`` (or ``O``); special pieces: the ignored id."""
    w = bio.col(word_ids)

    def run(ids: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            tag = F.get(bio.present(tags), x)
            later = F.when(tag.startswith("B-"), F.concat(F.lit("I-"), bio.entity(tag))).otherwise(tag)
            first = (i == 0) | (F.get(ids, i - 1) != x)
            label = F.when(first, tag).otherwise(later)
            known = F.create_map(*[v for n, k in bio.LABEL_IDS.items() for v in (F.lit(n), F.lit(k))])
            return F.when(x < 0, F.lit(bio.IGNORED)).otherwise(F.coalesce(F.try_element_at(known, label), F.lit(0)))

        return F.transform(ids, one)

    return bio.let(w, run)


def fitted(labels: Column | str, size: int = MAX_PIECES, fill: int = bio.IGNORED) -> Column:
    """Cut or filled to ``size``."""
    return F.slice(F.concat(bio.col(labels), F.array_repeat(F.lit(fill), size)), 1, size)


def word_tags(word_ids: Column | str, labels: Column | str, tokens: Column | str) -> Column:
    """Back to words: the first piece wins, words without a piece are ``O``."""
    w, y = bio.col(word_ids), bio.col(labels)
    return F.transform(bio.present(tokens), lambda _, i: F.coalesce(bio.tag_from_int(F.get(y, (F.array_position(w, i) - 1).cast("int"))), F.lit("O")))


def label_faults(labels: Column | str) -> Column:
    """Why labels are invalid, or null: an id out of the set, or a row that starts with ``I-``."""
    y = bio.col(labels)
    real = F.filter(y, lambda v: v != bio.IGNORED)
    return F.when(F.exists(y, lambda v: ~v.isin(bio.IGNORED, *bio.LABEL_IDS.values())), "unknown id").when(F.get(real, F.lit(0)).isin(2, 4), "starts inside")


def argmax(scores: Column | str) -> Column:
    v = bio.col(scores)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
