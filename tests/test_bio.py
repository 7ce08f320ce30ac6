"""Tag algebra against plain restatements of the rules."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import bio

TAGS = list(bio.TAGS)


def spans(tags):
    out, i = [], 0
    while i < len(tags):
        if tags[i][0] == "B":
            j = i + 1
            while j < len(tags) and tags[j] == "I-" + tags[i][2:]:
                j += 1
            out.append((i, j, tags[i][2:]))
            i = j
        else:
            i += 1
    return out


def repaired(tags):
    out = list(tags)
    for i, t in enumerate(out):
        if t[0] == "I" and (i == 0 or out[i - 1] == "O" or out[i - 1][2:] != t[2:]):
            out[i] = "B-" + t[2:]
    return out


def late(tags, kind):
    out, start = set(), None
    for i, t in enumerate(tags):
        if t == "B-" + kind:
            start = i
        elif t == "O" or (t[0] == "B" and t != "B-" + kind):
            if start is not None:
                out.add((start, i, kind))
            start = None
    return sorted(out | ({(start, len(tags), kind)} if start is not None else set()))


def triples(rows):
    return [(r.s, r.e, r.label) for r in rows]


def test_all_short_sequences(spark):
    rows = [list(c) for n in range(6) for c in itertools.product(TAGS, repeat=n)]
    df = spark.createDataFrame([(r,) for r in rows], "tags array<string>").repartition(8)
    got = df.select("tags", bio.spans("tags").alias("s"), bio.repair("tags").alias("r"), bio.late_spans("tags", "PER").alias("l"), bio.is_valid_bio("tags").alias("v")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert triples(r.s) == spans(r.tags)
        assert r.r == repaired(r.tags)
        assert sorted(triples(r.l)) == late(r.tags, "PER")
        assert r.v == (r.tags == repaired(r.tags))


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None), ([], [])], "tags array<string>, pred array<string>")
    for r in df.select(bio.spans("tags").alias("s"), bio.repair("tags").alias("r"), bio.count_spans("tags", "PER").alias("n"), bio.padded("pred", "tags").alias("p"), bio.first_present("tags", "pred").alias("f")).collect():
        assert (r.s, r.r, r.n, r.p, r.f) == ([], [], 0, [], [])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(TAGS), max_size=6), st.lists(st.sampled_from(TAGS), max_size=6)), min_size=1, max_size=20))
def test_padding(spark, rows):
    df = spark.createDataFrame(rows, "gold array<string>, pred array<string>")
    for r in df.select("*", bio.padded("pred", "gold").alias("p")).collect():
        assert r.p == (r.pred + ["O"] * len(r.gold))[: len(r.gold)]


@pytest.mark.parametrize(("n", "bucket"), [(0, "zero_per"), (1, "one_per"), (2, "multi_per"), (9, "multi_per")])
def test_bucket(spark, n, bucket):
    assert spark.range(1).select(bio.density_bucket(F.lit(n))).first()[0] == bucket


def test_foreign_tags(spark):
    names = F.array(*map(F.lit, ["O", "B-PER", "I-PER", "B-ORG", "I-ORG"]))
    df = spark.createDataFrame([([0, 1, 2, 3, 4, 99],)], "ids array<int>")
    assert df.select(bio.people_only("ids", names)).first()[0] == ["O", "B-PER", "I-PER", "O", "O", "O"]


def test_ratio_by_zero(spark):
    assert spark.range(1).select(bio.ratio(F.lit(1), F.lit(0)), bio.f1(F.lit(0), F.lit(0), F.lit(0))).first()[:] == (0.0, 0.0)
