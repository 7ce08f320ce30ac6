"""What the search for cut texts asks of the driver: no bitmap in the plans it keeps, no whole texts in its sample."""

import random
import re

import pytest

from tagloom.llm import truncation
from tests.llm.test_operators import WHOLE, cut_docs, folder


def test_plans_without_bitmaps(spark, tmp_path, monkeypatch):
    size = lambda df: len(df._jdf.queryExecution().executedPlan().toString())
    sizes, stage = {}, truncation.stage
    monkeypatch.setattr(truncation, "stage", lambda df, name: (sizes.update({name: size(df)}), stage(df, name))[1])
    items = [(f"Part {n} tells how the long road to the {'far ' * 8 * n}east was made in {1800 + n}", "never") for n in range(9)]
    items += [("Part 1 tells how the long ro", "never"), (WHOLE[:60], "a"), *[(WHOLE, "a")] * 5]
    found = truncation.p8_found(spark, folder(spark, tmp_path, documents=cut_docs(spark, items)))
    sizes["result"] = size(found)
    assert {"p8-words", "p8-texts"} < set(sizes)
    sizes.pop("p8-places", None)  # the one plan of the words that are looked for
    assert max(sizes.values()) < 60_000, sizes
    assert sorted(r.doc_id for r in found.collect()) == [9, 10]


def test_sample_of_the_sort_is_small(spark):
    """The driver's sample for the ranges has the starts of texts: 200 texts of 30,000 characters are 6 MB, their starts are not."""
    r = random.Random(3)
    texts = [f"{i:03} " + "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=30_000)).strip() for i in range(100)]
    docs = cut_docs(spark, [(t, "a") for t in texts] + [(t[:29_000].strip(), "a") for t in texts])
    sc = spark.sparkContext

    def stages():
        kept = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {x.stageId(): x.resultSize() for x in map(kept.apply, range(kept.size()))}

    before = stages()
    found = sorted(x.doc_id for x in truncation.prefix_of_longer(docs).collect())
    assert found == [*range(100, 200)]
    assert max(v for k, v in stages().items() if k not in before) < 1_000_000


@pytest.mark.parametrize("hot", [1, 3, 20])
def test_starts_of_hot_prefixes(spark, monkeypatch, hot):
    """Prefixes that many texts share are told apart by longer ones; the order of the texts and the pairs stay."""
    monkeypatch.setattr(truncation, "HOT_ROWS", hot)
    r = random.Random(hot)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(60)] + ["abab" * 5 + "".join(r.choice("ab\n") for _ in range(r.randint(0, 60))) + "b" for _ in range(60)]
    texts += [t[: r.randint(1, len(t))] for t in texts[60:]] + ["abab" * 5] * 8
    plain = [re.sub(r"[ \t]*\n\s*", truncation.BREAK, t.rstrip()) for t in texts]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.doc_id for x in truncation.prefix_of_longer(cut_docs(spark, [(t, "a") for t in texts])).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {i for i, t in enumerate(plain) if t and any(o != t and o.startswith(t) for o in plain)}
