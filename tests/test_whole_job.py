"""Registered queries do the whole job: cases that smaller stand-ins lose."""

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.queries import ORACLES, QUERIES
from tagloom.queries.metrics import _all_pairs
from tests.oracle import connection

SPLIT = "idx long, lang string, sequence string, tokens array<string>, ner_tags array<string>"


def test_word_tags_beyond_64_pieces(spark, tmp_path):
    tags = lambda n, *at: ["B-PER" if i in at else "O" for i in range(n)]
    rows = [(1, "en", "", ["word"] * 100, tags(100, 0, 62, 63, 99)), (2, "en", "", ["word"] * 300, tags(300, 253, 254, 299)), (3, "en", "", ["longword"] * 60, tags(60, 59))]
    spark.createDataFrame(rows, SPLIT).write.parquet(str(tmp_path / "test_injected.parquet"))
    got = {r.idx: [i for i, t in enumerate(r.tags.split(" ")) if t != "O"] for r in QUERIES["enc01_word_tags"](spark, str(tmp_path)).collect()}
    # 256 pieces hold 254 of the text between the two special ones
    assert got == {1: [0, 62, 63, 99], 2: [253], 3: [59]}


def portable(x, salt, p=2147483647):
    a = (x % p * 48271 + salt * 40692 + 12345) % p
    b = (a * a + salt * 7919 + 1) % p
    return (b * b + a * 16807) % p


def test_bootstrap_of_every_encoder(spark, data):
    got = QUERIES["bst03_resamples"](spark, data).collect()
    diffs = {e: [r.diff for r in sorted(got, key=lambda r: r.b) if r.encoder == e] for e in ("encoder_a", "encoder_b")}
    assert len(got) == 2000 and [len(v) for v in diffs.values()] == [1000, 1000]
    pairs = {e: sorted((r.idx, r.fa - r.fb) for r in _all_pairs(spark, data).where(F.col("encoder") == e).collect()) for e in diffs}
    for e, d in pairs.items():
        n = len(d)
        want = [sum(d[portable(b * 1000003 + k, 42) % n][1] for k in range(n)) / n for b in range(1000)]
        assert diffs[e] == pytest.approx(want, abs=2e-6)
        ordered = sorted(want)
        of = lambda name: next(r for r in QUERIES[name](spark, data).collect() if r.encoder == e)  # noqa: E731,B023
        low, high = of("bst05_index_interval")[1:]
        assert (low, high) == pytest.approx((ordered[25], ordered[975]), abs=2e-6)
        linear = of("bst04_linear_interval")[1:]
        assert linear == pytest.approx(np.percentile(want, [2.5, 97.5]), abs=2e-6)
        p = sum(x <= 0 for x in want) / 1000
        r = of("bst06_p_value")
        assert r.p_value == pytest.approx(p) and (p > 0 or r.shown == "<1/1000")
        r = of("bst07_all_pairs")
        assert (r.resamples, r.n) == (1000, n) and (r.low, r.high, r.p_value) == pytest.approx((*linear, p))


def test_subset_of_three_splits(spark, data, tmp_path):
    for split, (first, n) in {"train": (0, 2600), "val": (5000, 700), "test": (9000, 800)}.items():
        spark.range(first, first + n).selectExpr("id AS idx", "'en' AS lang", "'' AS sequence", "array('a') AS tokens", "array('O') AS ner_tags").write.parquet(str(tmp_path / f"{split}_injected.parquet"))
    got = [(r.split, r.idx) for r in QUERIES["smp02_subset"](spark, str(tmp_path)).collect()]
    assert [sum(s == x for s, _ in got) for x in ("train", "val", "test")] == [2500, 500, 500] and len(set(got)) == 3500
    assert [i for s, i in got if s == "test"] == [*range(9000, 9500)]
    val = sorted(range(5000, 5700), key=lambda i: (portable(i, 42), i))[:500]
    assert [i for s, i in got if s == "val"] == sorted(val)
    assert {(r.split, r.idx) for r in QUERIES["smp02_subset"](spark, data).collect()} == set(connection(data).execute(ORACLES["smp02_subset"]).fetchall())


def test_checksums_of_every_table(spark, data, tmp_path):
    for t in ("a", "b"):
        (tmp_path / f"{t}.parquet").mkdir()
        (tmp_path / f"{t}.parquet" / "part-00000.parquet").write_text(t)
    parts = {r.name: r.digest for r in QUERIES["snk06_file_checksums"](spark, str(tmp_path)).collect()}
    assert parts == {f"{t}.parquet/part-00000.parquet": hashlib.sha256(t.encode()).hexdigest() for t in ("a", "b")}
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(data).glob("*.parquet")}
    assert len(want) > 1 and {r.name: r.digest for r in QUERIES["snk06_file_checksums"](spark, data).collect()} == want


PREDICTIONS = "model string, idx long, tokens array<string>, gold_tags array<string>, pred_tags array<string>, sequence string, run_at timestamp"
ANSWERS = "idx long, tokens array<string>, sequence string, raw_response string, predicted_tags array<string>, parse_ok boolean, ner_tags array<string>"


def test_sentence_leaks_on_stored_texts(spark, tmp_path):
    """The stored text is masked, stale or not; every record counts; tags that do not fit mask nothing."""
    row = lambda i, tokens, gold, pred, text: ("m", i, tokens, gold, pred, text, None)
    rows = [
        row(1, ["Ann", "Lee", "left"], ["B-PER", "I-PER", "O"], ["B-PER", "I-PER", "O"], "Ann Lee left"),  # masked
        row(2, ["Ann", "Lee", "left"], ["B-PER", "I-PER", "O"], ["B-PER", "O", "O"], "Ann Lee left"),  # "Lee" stays, the whole name does not
        row(3, ["Ann", "a@b.com"], ["B-PER", "B-EMAIL"], ["B-PER", "B-EMAIL"], "Ann and ANN"),  # stale: one more "ANN", no address
        row(4, ["Bo", "left"], ["B-PER", "O", "O"], ["B-PER", "O", "O"], "Bo left"),  # more tags than tokens: left as it is
        row(5, ["Bo", "left"], ["B-PER", "O"], ["O", "O"], None),  # rebuilt, then missed
        row(6, [], [], [], ""), row(7, None, None, None, "Bo"), row(8, ["", "x"], ["B-PER", "O"], ["O", "O"], "x"),  # nothing to leak
    ]
    spark.createDataFrame(rows, PREDICTIONS).write.parquet(str(tmp_path / "encoder_predictions.parquet"))
    spark.createDataFrame([], ANSWERS).write.parquet(str(tmp_path / "llm_predictions.parquet"))
    r = QUERIES["met09_sentence_leak"](spark, str(tmp_path)).first()
    assert (r.leaked, r.sentences) == (3, 8)
    masked = {x.idx: x.masked for x in QUERIES["msk01_03_masked"](spark, str(tmp_path)).collect()}
    assert masked == {1: "[NAME] left", 2: "[NAME] Lee left", 3: "[NAME] and ANN", 4: "Bo left", 5: "Bo left", 6: "", 7: "Bo", 8: "x"}
    assert connection(str(tmp_path)).execute(ORACLES["met09_sentence_leak"]).fetchall() == [("m", 3, 8, 0.375)]


def test_stream_takes_the_latest_run(spark, tmp_path):
    """Repeated and late runs, within and across batches, count once."""
    tags = lambda *t: list(t)
    time = lambda k: __import__("datetime").datetime(2024, 1, k)
    rows = [("m", 1, ["a"], tags("B-PER"), tags("O"), "a", time(1)), ("m", 1, ["a"], tags("B-PER"), tags("B-PER"), "a", time(2)), ("m", 1, ["a"], tags("B-PER"), tags("O"), "a", time(1)), ("m", 2, ["a"], tags("O"), tags("B-PER"), "a", time(1))]
    spark.createDataFrame(rows * 2, PREDICTIONS.replace("timestamp", "timestamp_ntz")).repartition(8).write.parquet(str(tmp_path / "encoder_predictions.parquet"))
    r = QUERIES["stream_scores"](spark, str(tmp_path)).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 0)
