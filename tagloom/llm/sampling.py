"""Problem 5: a sample whose shares match given targets.

The categories of a target set form a tree: root, density bucket, number of e-mail spans.  Every
leaf takes what it wants as far as it has rows.  Quota that a leaf cannot fill goes first to its
siblings (leaves of one bucket), then to its cousins, largest spare first; what the whole set
cannot fill is reported.  Where minimums push the quotas over the size of the sample, the surplus is
taken back from the leaves that are above their minimum, the one farthest above first; what minimums alone
exceed the sample by is reported as ``over_sample``.  Rows are drawn at the leaves by a permuted dense rank, which is sliced, so
a leaf may hold any share of all rows.

Only counts of the categories of ``targets`` (a small, fixed table) meet the allocation, which is
itself declarative.  Defined cases: rows with a null bucket or a null number belong to no category
but count among the n rows; a row of targets with a null part wants nothing that exists; ids count
once; an empty table leaves every positive want unmet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.ranking import ranked
from tagloom.plans.staging import stage, table

LEAF = ["entity_density_bucket", "n_email_spans"]


def categories(rows: DataFrame) -> DataFrame:
    """(idx, bucket, n_email_spans) with one row for each id and both parts in one form."""
    bucket = F.lower(F.regexp_replace("entity_density_bucket", r"^\s+|\s+$", ""))
    return (
        rows.where(F.col("idx").isNotNull())
        .select("idx", bucket.alias(LEAF[0]), F.least("n_email_spans", F.lit(2)).cast("int").alias(LEAF[1]))
        .dropDuplicates(["idx"])
    )


def wants(cats: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets with the wanted and the available rows of each leaf."""
    targets = targets.select("target_set", *LEAF, "target_per_mille", "min_rows", "sample_per_mille")
    total = cats.agg(F.count(F.lit(1)).alias("n_rows"))
    available = cats.where(F.col(LEAF[0]).isNotNull() & F.col(LEAF[1]).isNotNull()).groupBy(*LEAF).agg(F.count(F.lit(1)).alias("available"))
    leaves = targets.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")
    size = F.floor(F.col("n_rows") * F.col("sample_per_mille") / 1000)
    return (
        leaves.join(available, LEAF, "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("sample_rows", size.cast("long"))
        .withColumn("wanted", F.greatest(F.col("min_rows").cast("long"), F.floor(F.col("sample_rows") * F.col("target_per_mille") / 1000)))
    )


def _passed(rows: DataFrame, group: list[str], name: str) -> DataFrame:
    """Passes the unmet quota of each group to its leaves with spare rows, largest spare first."""
    whole = Window.partitionBy(*group)
    before = whole.orderBy(F.desc("spare"), *LEAF).rowsBetween(Window.unboundedPreceding, -1)
    quota, room = F.sum("unmet").over(whole), F.sum("spare").over(whole)
    moved = F.least(quota, room)
    given = F.greatest(F.lit(0), F.least(F.col("spare"), moved - F.coalesce(F.sum("spare").over(before), F.lit(0))))
    # what is left unmet stays with the leaves that lack rows, in leaf order
    covered = whole.orderBy(*LEAF).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), F.col("unmet") - F.greatest(F.lit(0), moved - F.coalesce(F.sum("unmet").over(covered), F.lit(0))))
    out = rows.withColumns({name: given, "_left": left})
    return out.withColumn("spare", F.col("spare") - F.col(name)).withColumn("unmet", F.col("_left")).drop("_left")


def _taken_back(rows: DataFrame) -> DataFrame:
    """Takes the quotas over the size of the sample back from leaves above their minimum."""
    whole = Window.partitionBy("target_set")
    rows = rows.withColumn("_room", F.greatest(F.lit(0), F.col("quota") - F.coalesce("min_rows", F.lit(0))))
    over = F.greatest(F.lit(0), F.sum("quota").over(whole) - F.col("sample_rows"))
    before = whole.orderBy(F.desc("_room"), *LEAF).rowsBetween(Window.unboundedPreceding, -1)
    back = F.greatest(F.lit(0), F.least(F.col("_room"), over - F.coalesce(F.sum("_room").over(before), F.lit(0))))
    rows = rows.withColumn("taken_back", back).withColumn("quota", F.col("quota") - F.col("taken_back")).drop("_room")
    return rows.withColumn("over_sample", F.greatest(F.lit(0), F.sum("quota").over(whole) - F.col("sample_rows")))


def allocation(cats: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: wanted, available, taken, passed on by siblings and cousins, taken back, quota and whether it is met."""
    rows = wants(cats, targets).withColumn("taken", F.least("wanted", "available"))
    rows = rows.withColumns({"spare": F.col("available") - F.col("taken"), "unmet": F.col("wanted") - F.col("taken")}).withColumn("short", F.col("unmet"))
    rows = _passed(rows, ["target_set", LEAF[0]], "from_siblings")
    rows = _passed(rows, ["target_set"], "from_cousins")
    rows = rows.withColumn("quota", F.col("taken") + F.col("from_siblings") + F.col("from_cousins")).withColumn("met", F.col("short") == 0)
    return _taken_back(rows)


#: Leaves of all target sets that are sent to the executors at most.
MOST_LEAVES = 100_000


def draw(cats: DataFrame, plan: DataFrame) -> DataFrame:
    """(target_set, idx, leaf): each leaf's quota of rows by permuted dense rank."""
    leaves = stage(plan.where("quota > 0").select("target_set", *LEAF, "quota"), "p5-leaves")
    if leaves.limit(MOST_LEAVES + 1).count() <= MOST_LEAVES:
        leaves = F.broadcast(leaves)
    return ranked(cats.join(leaves, LEAF), ["target_set", *LEAF], ["idx"]).where("rank < quota").select("target_set", "idx", *LEAF)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return stage(categories(table(spark, sf_dir, "train_injected")), "p5-categories"), table(spark, sf_dir, "sample_targets")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_set, entity_density_bucket, n_email_spans) of the targets that cannot be met."""
    return allocation(*_inputs(spark, sf_dir)).where(~F.col("met")).select("target_set", *LEAF)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allocation of every target."""
    keep = ["target_set", *LEAF, "sample_rows", "wanted", "available", "taken", "from_siblings", "from_cousins", "taken_back", "quota", "met", "over_sample"]
    return allocation(*_inputs(spark, sf_dir)).select(*keep)


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_set, idx, leaf): the drawn rows of every target set."""
    cats, targets = _inputs(spark, sf_dir)
    return draw(cats, allocation(cats, targets))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_set, leaf, n_rows, n_ids): what was drawn of each leaf; the rows are the quotas of ``p5_report``."""
    return p5_sample(spark, sf_dir).groupBy("target_set", *LEAF).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("idx").alias("n_ids"))
