"""Problem 2: records that are one sentence in another layout.

Two records of one table are copies when the keys (letters and digits, lower-cased) of ``sequence``
are equal and the keys of ``tokens`` are equal.  Classes are refined step by step: first by the two
stripped lengths, then by a histogram of frequent letters, last by 128 bits of hash of the whole
keys, for which only the texts of the rows that are left are read again.

A step counts its classes (combined before the shuffle, so a class of a third of all rows costs one row for each
input partition) and marks the ones with several rows in a bitmap of fixed size; the rows are filtered where they are,
so no class is gathered anywhere.  A row that a step drops is single for sure; one that passes by chance meets the next
step.  The last step names the classes; a class of more than a thousandth of the rows is spread over ``SALTS`` tasks.

Defined cases: null and empty sequences and payloads that do not parse belong to no class; null
tokens have the empty key; rows of one id (re-deliveries) count once; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.bitmaps import hash_filter
from tagloom.plans.staging import stage, table

#: Groups of letters for the histogram, 10 bits each: the most frequent ones of Latin, Cyrillic, Greek, Arabic, Devanagari, kana, Han and Hangul texts.
LETTERS = ("eоαاकの的이", "tеοيरい一다", "aаιلनる是는", "oиεمसし不가", "iнτنतた了을", "nтσرमに人의")
PAYLOAD = "sequence string, tokens array<string>, _bad string"
#: Bits of the table of classes with several rows.
CLASS_BITS = 1 << 22
#: A class of over this share of the rows is spread over so many tasks.
HOT_SHARE, SALTS = 0.001, 64
STEPS = (["table_name", "len_s", "len_t"], ["table_name", "len_s", "len_t", "letters"])


def key_of(text: Column) -> Column:
    """The words of a text joined without blanks."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _histogram(key: Column) -> Column:
    counts = [F.length(key) - F.length(F.translate(key, letters, "")) for letters in LETTERS]
    return reduce(lambda a, c: a * 1024 + F.least(c, F.lit(1023)).cast("long"), counts, F.lit(0).cast("long"))


def _keys(df: DataFrame) -> DataFrame:
    rows = df.where(F.col("id").isNotNull() & (F.col("sequence") != ""))
    return rows.select("id", key_of(F.col("sequence")).alias("ks"), key_of(F.coalesce(F.array_join("tokens", ""), F.lit(""))).alias("kt"))


def invariants(df: DataFrame, table_name: str) -> DataFrame:
    """(table_name, id, len_s, len_t, letters) of rows (id, sequence, tokens)."""
    return _keys(df).select(F.lit(table_name).alias("table_name"), "id", F.length("ks").alias("len_s"), F.length("kt").alias("len_t"), _histogram(F.col("ks")).alias("letters"))


def hashed(df: DataFrame, table_name: str) -> DataFrame:
    """(table_name, id, h1, h2): 128 bits of hash of the two keys."""
    return _keys(df).select(F.lit(table_name).alias("table_name"), "id", F.xxhash64("ks", "kt").alias("h1"), F.xxhash64(F.lit(1), F.reverse("kt"), F.reverse("ks")).alias("h2"))


def parsed_payloads(raw: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """(id, sequence, tokens) of the payloads that parse as one JSON object."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
    j = raw.select(F.col(key).alias("id"), F.from_json(payload, PAYLOAD, options).alias("j"))
    return j.where(F.col("j").isNotNull() & F.col("j._bad").isNull()).select("id", "j.sequence", "j.tokens")


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str, object]]:
    """Table, id column and a function to (id, sequence, tokens), by table name."""
    train = lambda df: df.select(F.col("idx").alias("id"), "sequence", "tokens")
    return {"train_injected": (table(spark, sf_dir, "train_injected"), "idx", train), "raw_examples": (table(spark, sf_dir, "raw_examples"), "raw_id", parsed_payloads)}


def _class(by: list[str]) -> Column:
    return F.xxhash64(*by)


def refine(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose class by ``by`` may have several rows, rows that are single)."""
    several = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(_class(by).alias("c"))
    may = hash_filter(several, "c", CLASS_BITS)
    return rows.where(may(_class(by))), rows.where(~may(_class(by)))


def refined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    """(table_name, id, h1, h2) of the rows that the cheap steps leave, and what each step leaves, the first being all rows."""
    sources = _sources(spark, sf_dir)
    rows = stage(reduce(DataFrame.unionByName, (invariants(get(df), name) for name, (df, _, get) in sources.items())), "p2-invariants")
    left = [rows]
    for by in STEPS:
        left.append(refine(left[-1], by)[0])
    ids = stage(left[-1].select("table_name", "id").distinct(), "p2-left")
    may = hash_filter(ids, "id", CLASS_BITS)  # the texts of the other rows are not parsed again
    keys = reduce(DataFrame.unionByName, (hashed(get(df.where(may(F.col(key)))), name) for name, (df, key, get) in sources.items()))
    return stage(keys.join(ids, ["table_name", "id"], "left_semi"), "p2-keys"), left


def groups(rows: DataFrame) -> DataFrame:
    """(table_name, keep_id, id) of every row in a class of several ids, kept ids included; rows: (table_name, id, h1, h2)."""
    by = ["table_name", "h1", "h2"]
    classes = rows.groupBy(*by).agg(F.min("id").alias("keep_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n")).where("keep_id < last_id").drop("last_id")
    total = rows.count()
    hot = [r.h1 for r in classes.where(F.col("n") > max(HOT_SHARE * total, 1)).select("h1").collect()]  # fewer than 1 / HOT_SHARE rows
    if total < SALTS / HOT_SHARE or not hot:  # small tables need no salt
        return rows.join(classes, by).select("table_name", "keep_id", "id").distinct()
    is_hot = F.col("h1").isin(hot)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    return salted.join(classes.withColumn("salt", F.explode(salts)), [*by, "salt"]).select("table_name", "keep_id", "id").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, keep_id, copy_id): one row for each copy of a kept record."""
    g = groups(refined(spark, sf_dir)[0])
    return g.where("id <> keep_id").select("table_name", "keep_id", F.col("id").alias("copy_id"))


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, keep_id, copies): one row for each sentence, with its number of records, single ones included."""
    keys, left = refined(spark, sf_dir)
    classes = keys.groupBy("table_name", "h1", "h2").agg(F.min("id").alias("keep_id"), F.countDistinct("id").alias("copies")).select("table_name", "keep_id", "copies")
    single = [refine(rows, by)[1].select("table_name", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("copies")) for rows, by in zip(left, STEPS)]
    return reduce(DataFrame.unionByName, single, classes)


def p2_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, n_rows): the rows at the start and after each step, and the copies in the end."""
    keys, left = refined(spark, sf_dir)
    counts = [df.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("n_rows")) for name, df in zip(("all", "lengths", "letters"), left)]
    return reduce(DataFrame.unionByName, [*counts, groups(keys).where("id <> keep_id").agg(F.lit("copies").alias("step"), F.count(F.lit(1)).alias("n_rows"))])
