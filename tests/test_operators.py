"""Unit cases of the operators."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tagloom.functions import bio
from tagloom.operators import alignment, bootstrap, errors, injection, masking, metrics, reports, responses, splits, validation
from tagloom.plans.numbering import numbered
from tagloom.sources import readers, sinks

EX = "idx long, lang string, sequence string, tokens array<string>, tags array<string>"


def examples(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EX)


def test_status_stops_at_first_failure(spark):
    df = examples(
        spark, ("en", "a b c", ["a", "b", "c"], ["O", "I-PER", "O"]), ("en", "a", ["a", "b", "c"], ["O", "O"]), ("en", "", ["a"], ["B-LOC"]),
        ("en", "", ["a", ""], ["O", "O"]), ("de", "a b", ["a", "b"], ["I-PER", "O"]), (None, "a", ["a"], ["O"]), ("en", "", [], []),
    )
    got = {r.idx: r for r in validation.status(df).collect()}
    assert [got[i].status for i in range(7)] == ["valid", "length_mismatch", "unknown_tags", "empty_token", "non_english", "non_english", "empty_token"]
    assert got[0].fixed_tags == ["O", "B-PER", "O"] and got[0].fixes == [1]
    assert got[4].fixes == [0] and got[1].fixes == []
    assert [r.idx for r in validation.clean(df).collect()] == [0]


def test_strict_check_raises(spark):
    bad = examples(spark, ("en", "a b", ["a", "b"], ["B-EMAIL", "I-PER"]))
    with pytest.raises(PySparkException, match="orphan at 1 I-PER token b"):
        validation.verify_strict(bad).collect()


def masked(spark, sequence, tokens, tags):
    df = spark.createDataFrame([(sequence, tokens, tags)], "sequence string, tokens array<string>, pred array<string>")
    return masking.masked(df.withColumn("pred_spans", bio.spans("pred"))).first()


@pytest.mark.parametrize(("sequence", "tokens", "tags", "want"), [
    ("Hello John Smith here", ["Hello", "John", "Smith", "here"], ["O", "B-PER", "I-PER", "O"], "Hello [NAME] here"),
    ("Mail a @ b.com now", ["Mail", "a", "@", "b.com", "now"], ["O", "B-EMAIL", "I-EMAIL", "I-EMAIL", "O"], "Mail [EMAIL] now"),
    ("a a a", ["a", "a", "a"], ["O", "B-PER", "O"], "a [NAME] a"),
    ("x y", ["x", "gone", "y"], ["O", "B-PER", "O"], "x y"),
    ("x é😀 y", ["x", "é😀", "y"], ["O", "B-LOC", "O"], "x [LOC] y"),
    ("", [], [], ""),
    (None, ["a"], ["B-PER"], None),
])
def test_masking(spark, sequence, tokens, tags, want):
    assert masked(spark, sequence, tokens, tags).masked == want


def plain_mask(sequence, tokens, spans):
    at, where = 0, []
    for t in tokens:
        i = sequence.find(t, at)
        where.append((i, i + len(t)) if i >= 0 else (-1, -1))
        at = i + len(t) if i >= 0 else at
    done, cut = -1, []
    for s, e, kind in spans:
        ends = [b for _, b in where[s:e] if b >= 0]
        if where[s][0] >= 0 and ends and where[s][0] >= done:
            cut.append((where[s][0], ends[-1], {"PER": "[NAME]", "EMAIL": "[EMAIL]"}[kind]))
            done = ends[-1]
    for a, b, p in reversed(cut):
        sequence = sequence[:a] + p + sequence[b:]
    return sequence


def test_masking_random(spark):
    r = random.Random(4)
    rows = []
    for _ in range(400):
        tokens = [r.choice(["a", "b", "ab", "é", "😀x", ",", "ba"]) for _ in range(r.randint(0, 8))]
        text = r.choice(["", " "]).join(t for t in tokens if r.random() < 0.85)
        rows.append((text, tokens, [r.choice(bio.TAGS) for _ in tokens]))
    df = spark.createDataFrame(rows, "sequence string, tokens array<string>, pred array<string>").withColumn("pred_spans", bio.spans("pred"))
    for x in masking.masked(df).collect():
        assert x.masked == plain_mask(x.sequence, x.tokens, [(s.s, s.e, s.label) for s in x.pred_spans]), x


def scored(spark, gold, pred):
    df = spark.createDataFrame([("m", 0, gold, pred)], "model string, idx long, gold array<string>, pred array<string>")
    df = df.withColumns({"gold_spans": bio.spans("gold"), "pred_spans": bio.spans("pred")})
    return {r.label: (r.tp, r.fp, r.fn, r.f1) for r in metrics.scored(metrics.span_counts(df, ["model"])).collect()}, metrics.sentence_f1(df).first().f1


def test_scores(spark):
    assert scored(spark, ["B-PER", "I-PER", "O"], ["B-PER", "I-PER", "O"]) == ({"PER": (1, 0, 0, 1.0)}, 1.0)
    assert scored(spark, ["B-PER", "I-PER", "O"], ["B-PER", "O", "O"]) == ({"PER": (0, 1, 1, 0.0)}, 0.0)
    assert scored(spark, ["O"], ["O"]) == ({}, 0.0)
    assert scored(spark, ["B-PER", "B-EMAIL"], ["B-PER", "O"])[1] == 0.5


@pytest.mark.parametrize(("gold", "fn", "fp", "f1"), [(5210, 94, 95, 0.981863), (2190, 4, 2, 0.998630), (5210, 84, 116, 0.980865), (5210, 1374, 9261, 0.419075), (2190, 707, 3289, 0.426027)])
def test_published_buckets_give_published_scores(spark, gold, fn, fp, f1):
    assert spark.range(1).select(bio.f1(F.lit(gold - fn), F.lit(fp), F.lit(fn))).first()[0] == pytest.approx(f1, abs=2e-6)


def test_partial_miss_is_a_span_leak_only(spark):
    df = spark.createDataFrame([("John Smith", ["John", "Smith"], ["B-PER", "I-PER"], ["B-PER", "O"])], "sequence string, tokens array<string>, gold array<string>, pred array<string>")
    df = df.withColumns({"gold_spans": bio.spans("gold"), "pred_spans": bio.spans("pred")})
    assert metrics.leaked_spans(df).first().leaked == 1
    assert masking.leaks(masking.masked(df)).first().leaks is False


@pytest.mark.parametrize(("counts", "want"), [((94, 4, 95, 2), (14, 1, 14, 1)), ((84, 0, 116, 0), (13, None, 17, None)), ((1374, 707, 9261, 3289), (3, 1, 19, 7))])
def test_quotas(spark, counts, want):
    df = spark.createDataFrame([("m", b) for b, n in zip(errors.BUCKETS, counts) for _ in range(n)], "model string, error_type string")
    got = {r.error_type: r.quota for r in errors.quotas(df).collect()}
    assert tuple(got.get(b) for b in errors.BUCKETS) == want


RESPONSES = [
    ('{"names": ["Ann Lee"], "emails": []}', 1, True, ["Ann Lee"], []),
    ('assistant\n\n{"names": ["Ann Lee"], "emails": ["a@b.com"]}', 1, True, ["Ann Lee"], ["a@b.com"]),
    ('```json\n{"names": ["Ann Lee"]}\n```', 1, True, ["Ann Lee"], []),
    ('```\n{"names": []}\n``` bye', 1, True, [], []),
    ('Here: {"names": ["Ann Lee"], "emails": []} done', 2, True, ["Ann Lee"], []),
    ('{"names": ["Ann Lee", "Bo', 3, True, ["Ann Lee"], []),
    ("nothing here", 0, False, [], []),
    ("[1, 2]", 1, False, [], []),
    ('{"names": null, "emails": []}', 1, False, [], []),
    ('{"names": ["Ann Lee", 5, null, " "], "emails": []}', 1, True, ["Ann Lee"], []),
    (None, 0, False, [], []),
    ("", 0, False, [], []),
]


def test_response_stages(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RESPONSES)], "idx long, raw_response string")
    got = {r.idx: r for r in responses.parsed(df).collect()}
    for i, (_, stage, ok, names, emails) in enumerate(RESPONSES):
        assert (got[i].stage, got[i].parse_ok, got[i].names, got[i].emails) == (stage, ok, names, emails), RESPONSES[i]


PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_align(tokens, names, emails):
    tags, low = ["O"] * len(tokens), [t.lower() for t in tokens]
    bare = [t.strip(PUNCT) for t in low]

    def put(at, n, kind):
        for k in range(n):
            tags[at + k] = ("I-" if k else "B-") + kind

    def window(parts, kind):
        for at in range(len(tokens) - len(parts) + 1):
            if bare[at : at + len(parts)] == parts and all(t == "O" for t in tags[at : at + len(parts)]):
                put(at, len(parts), kind)
                return True
        return False

    for kind, items in (("EMAIL", emails), ("PER", names)):
        for item in items:
            text = item.strip().lower()
            if "@" in text:
                hit = next((i for i, b in enumerate(bare) if b == text.strip(PUNCT) and tags[i] == "O"), None)
                if hit is not None:
                    put(hit, 1, kind)
                    continue
                parts = [p.strip(PUNCT) for p in text.replace("@", " @ ").split()]
                if len(parts) >= 2 and window(parts, kind):
                    continue
            parts = [p.strip(PUNCT) for p in text.split()]
            if parts:
                window(parts, kind)
    return tags


def test_alignment_random(spark):
    r = random.Random(9)
    rows = []
    for _ in range(500):
        tokens = [r.choice(["Ann", "Lee", "a@b.com", "a", "@", "b.com", ",", "(Ann)", "lee.", "x"]) for _ in range(r.randint(0, 9))]
        names = [r.choice(["Ann", "Ann Lee", "Lee", "x", "ann lee", " "]) for _ in range(r.randint(0, 3))]
        emails = [r.choice(["a@b.com", "A@B.COM", "a @ b.com", "q@r.s"]) for _ in range(r.randint(0, 2))]
        rows.append((tokens, names, emails))
    df = spark.createDataFrame(rows, "tokens array<string>, names array<string>, emails array<string>")
    for x in df.select("*", responses.aligned("tokens", "names", "emails").alias("tags")).collect():
        assert x.tags == plain_align(x.tokens, x.names, x.emails), x


def test_rule_backend_and_resume(spark):
    rows = spark.createDataFrame([(1, "Ann Lee wrote to ann@b.com ."), (2, "nobody")], "idx long, sequence string").withColumn("prompt", responses.prompt("sequence"))
    out = {r.idx: r for r in responses.parsed(responses.answered(rows, responses.rule_backend)).collect()}
    assert out[1].names == ["Ann Lee"] and out[1].emails == ["ann@b.com"] and out[2].parse_ok
    assert [r.idx for r in responses.pending(rows, rows.where("idx = 1")).collect()] == [2]


@pytest.mark.parametrize(("context", "multi", "tokens", "tags", "want", "at"), [
    ("post_name", False, ["Ann", "left", "."], ["B-PER", "O", "O"], ["Ann", ",", "a@b.com", "left", "."], 2),
    ("post_name", False, ["Ann", "."], ["B-PER", "O"], ["Ann", "a@b.com", "."], 1),
    ("post_name", True, ["Ann"], ["B-PER"], ["Ann", "a", "@", "b.com"], 1),
    ("parenthetical", True, ["Ann", "left"], ["B-PER", "O"], ["Ann", "(", "a", "@", "b.com", ")", "left"], 2),
    ("contact_tail", False, ["Ann", "left", "."], ["B-PER", "O", "O"], ["Ann", "left", "Email:", "a@b.com", "."], 3),
    ("contact_tail", False, ["Ann", "Lee", "!"], ["B-PER", "I-PER", "I-PER"], ["Ann", "Lee", "!", "Email:", "a@b.com"], 4),
])
def test_insertion(spark, context, multi, tokens, tags, want, at):
    end = next((i for i in range(1, len(tags)) if tags[i] == "O"), len(tags))
    df = spark.createDataFrame([(1, tokens, tags, "a@b.com", multi, context, (0, end, "PER"))], "idx long, tokens array<string>, tags array<string>, email string, multi_token boolean, context string, span struct<s:int,e:int,label:string>")
    r = injection.inserted(df.withColumn("v", F.lit(0))).select("*", bio.is_valid_bio("new_tags").alias("ok")).first()
    assert (r.new_tokens, r.inserted_at, r.ok) == (want, at, True)
    assert r.new_tags[at] == "B-EMAIL" and len(r.new_tags) == len(r.new_tokens)


def test_unknown_context_fails(spark):
    df = spark.createDataFrame([(1, ["a"], ["B-PER"], "a@b.com", False, "nowhere", (0, 1, "PER"))], "idx long, tokens array<string>, tags array<string>, email string, multi_token boolean, context string, span struct<s:int,e:int,label:string>")
    with pytest.raises(PySparkException, match="unknown context nowhere"):
        injection.inserted(df).collect()


def test_injection_rates(spark):
    rows = spark.range(4000).select(F.col("id").alias("idx"), F.array(F.lit("Ann"), F.lit("Lee"), F.lit(".")).alias("tokens"), F.array(F.lit("B-PER"), F.lit("I-PER"), F.lit("O")).alias("tags"))
    out = injection.injected(rows)
    assert out.count() == 2400
    share = {r[0]: r[1] / 2400 for r in out.groupBy("context").count().collect()}
    assert share["post_name"] == pytest.approx(0.5, abs=0.05) and share["contact_tail"] == pytest.approx(0.2, abs=0.05)
    assert out.where("multi_token").count() / 2400 == pytest.approx(0.1, abs=0.05)
    assert out.where(~F.col("email").rlike(validation.EMAIL_PATTERN)).count() == 0


def test_split_is_exact(spark):
    rows = spark.range(1001).select(F.col("id").alias("idx"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("bucket"))
    got = {(r.bucket, r.split): r["count"] for r in splits.stratified(rows, "bucket", 0.15).groupBy("bucket", "split").count().collect()}
    assert got[("a", "val")] + got[("b", "val")] == 151 and abs(got[("a", "val")] - 15) <= 1


def test_numbering_is_dense(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("a"), F.col("id").alias("b")).repartition(5)
    got = [(r.a, r.b) for r in numbered(rows, "a", "b").orderBy("k").collect()]
    assert got == sorted(got) and len(got) == 500
    assert numbered(rows.limit(0), "a", "b").count() == 0


def test_subword_labels(spark):
    df = spark.createDataFrame([(["John", "Smithson", "x@example.com", ""], ["B-PER", "I-PER", "B-EMAIL", "O"])], "tokens array<string>, tags array<string>")
    df = df.withColumn("w", alignment.chunk_word_ids("tokens")).withColumn("y", alignment.aligned_labels("w", "tags"))
    r = df.select("*", alignment.fitted("y").alias("f"), alignment.word_tags("w", "y", "tokens").alias("back"), alignment.label_faults("y").alias("bad")).first()
    assert r.y == [-100, 1, 2, 2, 3, 4, 4, 4, 0, -100] and len(r.f) == 256 and r.f[10] == -100
    assert r.back == r.tags and r.bad is None
    assert spark.range(1).select(alignment.label_faults(F.array(F.lit(-100), F.lit(2))), alignment.label_faults(F.array(F.lit(7)))).first()[:] == ("starts inside", "unknown id")


def test_bootstrap(spark):
    pairs = spark.range(300).select(F.col("id").alias("idx"), F.lit(0.9).alias("fa"), (F.col("id") % 2 * 0.5).alias("fb"))
    diffs = bootstrap.resampled(pairs, 50, 1)
    assert diffs.count() == 50 and diffs.agg(F.avg("diff")).first()[0] == pytest.approx(0.65, abs=0.02)
    low, high = bootstrap.index_interval(diffs).first()
    assert low < 0.65 < high
    exact = bootstrap.exact_resampled(pairs, 20)
    assert exact.count() == 20 and exact.agg(F.avg("diff")).first()[0] == pytest.approx(0.65, abs=0.05)
    assert bootstrap.resampled(pairs.limit(0), 5, 1).count() == 0


def test_readers_and_sinks(spark, tmp_path):
    array = tmp_path / "a.json"
    array.write_text('[{"lang": "en", "tokens": ["x"]}, {"lang": "de"}]')
    assert [(r.idx, r.lang) for r in readers.read_any_json(spark, str(array), readers.EXAMPLE).orderBy("idx").collect()] == [(0, "en"), (1, "de")]
    lines = tmp_path / "b.jsonl"
    lines.write_text('{"lang": "en"}\n\n{"lang": \n{"lang": "fr"}\n')
    assert readers.read_any_json(spark, str(lines), "lang string").select("lang").count() == 2
    good, bad = readers.read_jsonl_split(spark, str(lines), "lang string")
    assert (good.count(), bad.count()) == (2, 1)
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        readers.read_jsonl_strict(spark, str(lines), "lang string").collect()
    with pytest.raises(ValueError):
        readers.read_any_json(spark, "x.csv", "a int")
    with pytest.raises(FileNotFoundError, match="no1.*no2"):
        readers.require(spark, str(tmp_path / "no1"), str(array), str(tmp_path / "no2"))
    report = sinks.write_report(spark.range(2), str(tmp_path / "r" / "x.json"))
    assert report["rows"] == 2 and (tmp_path / "r" / "x.json").exists()
    digest = sinks.checksums(spark, str(array)).first()
    assert len(digest.digest) == 64 and digest.line.endswith("  a.json")
    (tmp_path / "c.yaml").write_text("seed: 42\nname: x\n")
    assert str(readers.read_config(str(tmp_path / "c.yaml"))["seed"]) == "42"


def test_stream_resumes(spark, tmp_path):
    from tagloom.streaming import scorer

    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    rows = spark.createDataFrame([("m", 1, ["a"], "a", ["B-PER"], ["B-PER"], None)], scorer.PREDICTION)
    rows.write.parquet(src)
    scorer.run_incremental(spark, src, out, at)
    rows.withColumns({"idx": F.lit(2).cast("long"), "pred_tags": F.array(F.lit("O"))}).write.mode("append").parquet(src)
    scorer.run_incremental(spark, src, out, at)
    r = scorer.running_scores(spark, out).first()
    assert (r.tp, r.fp, r.fn) == (1, 0, 1)


def test_answers_resume(spark, tmp_path):
    from tagloom.streaming import answers

    rows = spark.range(120).select(F.col("id").alias("idx"), F.format_string("Sentence: Ann Lee %d", "id").alias("prompt"))
    asked = str(tmp_path / "asked")

    def backend(prompts):  # notes what it is asked, and breaks off at one prompt until a file exists
        import os

        for p in prompts:
            if p.endswith(" 119") and not os.path.exists(asked + ".go"):
                raise ValueError("backend is gone")
        with open(asked, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return responses.rule_backend(prompts)

    ordered = rows.coalesce(1).sortWithinPartitions("idx")
    with pytest.raises(Exception, match="backend is gone"):
        answers.answer_resumably(ordered, backend, str(tmp_path / "run"), 50, 1)
    before = set(open(asked).read().split("\n"))
    (tmp_path / "asked.go").write_text("")
    (tmp_path / "asked").write_text("")
    done = answers.answer_resumably(ordered, backend, str(tmp_path / "run"), 50, 1)
    assert done.count() == 120 and done.where("raw_response like '%Ann Lee%'").count() == 120
    again = {x for x in open(asked).read().split("\n") if x}
    assert len(before) > 100 and again and not again & before
    assert answers.answer_resumably(rows.limit(0), responses.rule_backend, str(tmp_path / "none")).count() == 0


def test_refusals(spark, tmp_path):
    df = spark.createDataFrame([("Hello world", ["Hello", "world"], ["O"])], "sequence string, tokens array<string>, pred array<string>").withColumn("pred_spans", bio.spans("pred"))
    with pytest.raises(PySparkException, match="tags length 1 != tokens length 2"):
        masking.masked(df).collect()
    assert masking.masked(df, strict=False).first().masked == "Hello world"
    scores = lambda n: spark.range(n).select(F.col("id").alias("idx"), F.lit(0.5).alias("f1"))
    with pytest.raises(ValueError, match="unequal number: 3 and 2"):
        bootstrap.strict_pairs(scores(3), scores(2))
    assert bootstrap.strict_pairs(scores(3), scores(3)).count() == 3
    with pytest.raises(ValueError, match="over 1000 rows"):
        reports.markdown_table(spark.range(1001))
    assert len(reports.ascii_table(spark.range(1000))) == 1001
    assert reports.bars_svg(spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b<", "x", 0)], "g string, b string, n int"), "g", "b", "n").count("<rect") == 3
    injection.require_disjoint()
    with pytest.raises(ValueError, match="pools overlap.*acme.com"):
        injection.require_disjoint(injection.CONFIG, injection.TEST_CONFIG | {"corporate_domains": ["acme.com"]})


def test_malformed_lines_have_numbers(spark, tmp_path, caplog):
    path = tmp_path / "lines.jsonl"
    path.write_text("".join('{"lang": \n' if i % 37 == 5 else "\n" if i % 50 == 3 else '{"lang": "en"}\n' for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # the file in several blocks
    try:
        _, bad = readers.read_jsonl_split(spark, str(path), "lang string")
        assert sorted(r.line_no for r in bad.collect()) == [i + 1 for i in range(2000) if i % 37 == 5]
        assert readers.warn_malformed(bad) == len([i for i in range(2000) if i % 37 == 5]) and "malformed lines" in caplog.text
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_shared_folder_is_asked_for(spark):
    from types import SimpleNamespace

    from tagloom.plans.staging import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_command_line(capsys):
    from tagloom.__main__ import main

    assert main(["--list"]) == 0 and "met01_span_scores" in capsys.readouterr().out
