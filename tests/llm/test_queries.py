import pytest
from pyspark.sql import functions as F

from tagloom.llm.queries import ORACLES, QUERIES
from tagloom.plans.staging import stage, table
from tests.oracle import assert_same

COLUMNS = {
    "p1_found": ["idx_a", "idx_b"], "p2_found": ["table_name", "keep_id", "copy_id"], "p3_found": ["idx", "field", "kind", "value_key"], "p4_found": ["idx", "pos"],
    "p5_found": ["target_set", "entity_density_bucket", "n_email_spans"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    assert_same(spark, data, QUERIES[name], ORACLES[name])


@pytest.fixture(scope="module")
def result(spark, data):
    """Each query once."""
    done = {}
    return lambda name: done[name] if name in done else done.setdefault(name, stage(QUERIES[name](spark, data), name))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(result, name):
    df = result(name)
    assert df.columns == COLUMNS[name] and df.count() == df.distinct().count()


def ids(spark, data, *tables):
    return {r.idx for t in tables for r in table(spark, data, t).where("idx is not null").select("idx").collect()}


def test_reports_add_up(result):
    total = lambda name, c: result(name).agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]
    assert total("p1_report", "n_pairs") == result("p1_found").count()
    assert total("p8_report", "cut") == result("p8_found").count() > 0
    assert result("p8_report").where("by_prefix + by_end < cut").count() == 0
    assert total("p2_copies", "copies") - result("p2_copies").count() == result("p2_found").count()
    steps = {r.step: r.n_rows for r in result("p2_steps").collect()}
    assert steps["all"] >= steps["lengths"] >= steps["letters"] >= steps["copies"] == result("p2_found").count()


def test_every_record_comes_out_once(spark, data, result):
    splits = ("train_injected", "val_injected", "test_injected")
    rows = result("p4_tokens").collect()
    assert len(rows) == len({r.idx for r in rows}) and {r.idx for r in rows} == ids(spark, data, *splits)
    red = result("p3_redacted").collect()
    assert len(red) == len({r.idx for r in red}) and {r.idx for r in red} == ids(spark, data, "test_injected")
    docs = {r.doc_id for r in table(spark, data, "documents").collect()}
    assert {r.doc_id for r in result("p6_ids").collect()} == {r.doc_id for r in result("p6_decoded").collect()} == docs
    assert all((r.documents, r.over_capacity, r.wrong_pieces, r.gaps) == (len(docs), 0, 0, 0) for r in result("p7_rules").collect())
    assert all(r.least_containers <= r.containers <= 1.1 * r.least_containers + 1 for r in result("p7_report").collect())
    ways = result("p6_ways").first()
    assert ways.documents == len(docs) and 0 <= ways.long_chars <= ways.chars


def test_redaction_takes_out_what_was_found(spark, data, result):
    """The placeholders of a text are as many as the spans, and the values found are gone from it."""
    red = {r.idx: r for r in result("p3_redacted").collect()}
    found = [r for r in result("p3_found").collect() if r.field == "sequence" and r.kind == "EMAIL"]
    key = lambda t: "".join(c for c in t.lower() if c.isalnum())
    assert found and all(f"[{r.kind}]" in red[r.idx].sequence for r in found)
    assert sum(r.value_key in key(red[r.idx].sequence) for r in found) <= 0.02 * len(found)  # an address may also be read as words


def test_tokens_in_one_form_need_no_repair(spark, data, result):
    from tagloom.llm import lookalike

    changed = {(r.idx, r.pos) for r in result("p4_found").collect()}
    tokens = {r.idx: r.tokens for r in result("p4_tokens").collect()}
    assert changed and all(lookalike.repair(tokens[i][p])[0] == tokens[i][p] for i, p in changed)
