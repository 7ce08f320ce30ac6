"""Queries SRC-*, SNK-*, RPT-*, CLI-* and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagloom.functions import bio
from tagloom.operators import errors, inputs, metrics, reports
from tagloom.plans.staging import stage, staged_dir, table
from tagloom.queries.sql import ENC, ERR, SCORES, ex, ratio
from tagloom.sources import readers, sinks
from tagloom.streaming import scorer

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _path(spark, name: str) -> str:
    return f"{staged_dir(spark)}/{name}-{uuid.uuid4().hex}"


_ANN = "approach string, sentence_idx long, tokens string, error_type string, gold_span string, pred_span string, sub_label string, notes string"


@query("src01_json_array", "SELECT approach, sentence_idx, error_type, gold_span, pred_span FROM annotation_rows")
def _(spark, d):
    """The annotation sheet (60 rows, fixed) as one JSON array file, and read again with its positions."""
    path = _path(spark, "array")
    rows = table(spark, d, "annotation_rows").coalesce(1)
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return readers.read_json_array(spark, path, _ANN).where("idx >= 0").select("approach", "sentence_idx", "error_type", "gold_span", "pred_span")


@query("src02_parquet", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(DISTINCT idx) AS n_ids FROM {t}" for t in inputs.SPLITS.values()))
def _(spark, d):
    parts = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("idx").alias("n_ids")).select(F.lit(t).alias("table_name"), "*") for t in inputs.SPLITS.values()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("src03a_jsonl_strict", f"WITH {ex('test')} SELECT idx, lang, sequence, len(tokens) AS n_tokens FROM ex")
def _(spark, d):
    path = _path(spark, "lines")
    sinks.write_jsonl(inputs.examples(spark, d, "test").withColumn("n_tokens", F.size("tokens").cast("long")), path)
    return readers.read_jsonl_strict(spark, path, "idx long, lang string, sequence string, n_tokens long")


def _payload_lines(spark, d) -> str:
    path = _path(spark, "payloads")
    table(spark, d, "raw_examples").where("payload is not null").select(F.regexp_replace("payload", r"[\r\n]+", " ").alias("value")).write.text(path)
    return path


@query("src03b_jsonl_lenient", "SELECT count(*) AS n_rows, count(payload ->> '$.sequence') AS n_sequences FROM raw_examples WHERE json_valid(payload)")
def _(spark, d):
    rows = readers.read_jsonl_lenient(spark, _payload_lines(spark, d), readers.EXAMPLE)
    return rows.select("lang", "sequence", "tokens", "ner_tags").agg(F.count(F.struct("*")).alias("n_rows"), F.count("sequence").alias("n_sequences"))


@query("src03c_jsonl_malformed", "SELECT count(*) FILTER (json_valid(payload)) AS good, count(*) FILTER (NOT json_valid(payload)) AS bad FROM raw_examples WHERE payload IS NOT NULL")
def _(spark, d):
    good, bad = readers.read_jsonl_split(spark, _payload_lines(spark, d), readers.EXAMPLE)
    g, b = good.agg(F.count(F.lit(1)).alias("good")).withColumn("_one", F.lit(1)), bad.agg(F.count(F.lit(1)).alias("bad")).withColumn("_one", F.lit(1))
    return g.join(b, "_one").drop("_one")


@query("src03c_malformed_lines", "SELECT n AS line_no, payload AS line FROM (SELECT payload, row_number() OVER (ORDER BY error_type, sentence_idx, tokens) AS n FROM (SELECT *, CASE WHEN sentence_idx % 3 = 0 THEN '{\"cut\": ' ELSE '{}' END || ' ' AS payload FROM annotation_rows)) WHERE payload LIKE '%cut%'")
def _(spark, d):
    """The sheet (60 rows, fixed) as one file in which every line of a sentence number divisible by three is cut; the cut lines with their numbers."""
    path = _path(spark, "cut-lines")
    line = F.when(F.col("sentence_idx") % 3 == 0, '{"cut":  ').otherwise("{} ")
    table(spark, d, "annotation_rows").select("error_type", "sentence_idx", "tokens", line.alias("value")).coalesce(1).sortWithinPartitions("error_type", "sentence_idx", "tokens").select("value").write.text(path)
    return readers.read_jsonl_split(spark, path, "cut string")[1].select("line_no", "line")


@query("src04_06_fallback", f"WITH {ex('test')} SELECT idx, len(tokens) AS n_tokens FROM ex")
def _(spark, d):
    """The first path of a chain that exists: a missing file, then the Parquet table."""
    rows = readers.read_records(spark, f"{d}/no_such_table.jsonl", f"{d}/test_injected.parquet")
    return rows.where("idx is not null").dropDuplicates(["idx"]).select("idx", F.size(bio.present("tokens")).cast("long").alias("n_tokens"))


@query("src05_discovered", f"WITH {ENC} SELECT model, count(*) AS n_rows, min(idx) AS first_idx, max(idx) AS last_idx FROM enc GROUP BY model")
def _(spark, d):
    """Predictions written as one folder a model, found again by a glob; the model comes from the path."""
    folder = _path(spark, "found")
    rows = inputs.encoder_predictions(spark, d)
    for model in ("encoder_a", "encoder_b"):
        sinks.write_jsonl(rows.where(F.col("model") == model).drop("model"), f"{folder}/{model}_predictions")
    found = readers.read_discovered(spark, folder, "idx long, tokens array<string>, sequence string, gold_tags array<string>, pred_tags array<string>")
    return found.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("src07_llm_sorted", "SELECT coalesce(idx, 0) AS idx, parse_ok, raw_response FROM llm_predictions ORDER BY idx")
def _(spark, d):
    return table(spark, d, "llm_predictions").select(F.coalesce("idx", F.lit(0)).alias("idx"), "parse_ok", "raw_response").orderBy("idx")


@query("src08_encoder_loaded", f"WITH {ENC} SELECT model, idx, array_to_string(coalesce(pred_tags, []), ' ') AS pred FROM enc")
def _(spark, d):
    readers.require(spark, f"{d}/encoder_predictions.parquet", f"{d}/llm_predictions.parquet")
    return inputs.encoder_predictions(spark, d).select("model", "idx", F.array_join(bio.present("pred_tags"), " ").alias("pred"))


@query("snk03_report_json", f"WITH {SCORES} SELECT model, label, tp, fp, fn, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM sc")
def _(spark, d):
    """The scores as one JSON report file, and read again."""
    path = _path(spark, "report") + "/scores.json"
    sinks.write_report(metrics.scored(metrics.span_counts(inputs.spanned(spark, d), ["model"])).select("model", "label", "tp", "fp", "fn", "f1"), path)
    return readers.read_json_array(spark, path, "model string, label string, tp long, fp long, fn long, f1 double").drop("idx")


@query("snk04_jsonl_round_trip", f"WITH {ENC} SELECT model, count(*) AS n_rows, CAST(sum(len(coalesce(tokens, []))) AS BIGINT) AS n_tokens FROM enc GROUP BY model")
def _(spark, d):
    path = _path(spark, "round")
    sinks.write_jsonl(inputs.encoder_predictions(spark, d), path)
    rows = readers.read_jsonl_strict(spark, path, "model string, idx long, tokens array<string>")
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size(bio.present("tokens"))).alias("n_tokens"))


@query("snk05_sheet_round_trip", "SELECT approach, sentence_idx, error_type, coalesce(gold_span, '') AS gold_span, coalesce(pred_span, '') AS pred_span, coalesce(notes, '') AS notes FROM annotation_rows")
def _(spark, d):
    """The annotation sheet as TSV; the second write leaves the first one as it is."""
    path = _path(spark, "sheet")
    sheet = table(spark, d, "annotation_rows").na.fill("")
    sinks.write_sheet(sheet, path)
    sinks.write_sheet(sheet.limit(1), path)
    return sinks.read_sheet(spark, path, _ANN).na.fill("").select("approach", "sentence_idx", "error_type", "gold_span", "pred_span", "notes")


@query("snk06_digests", "SELECT raw_id, sha256(payload) AS digest FROM raw_examples WHERE payload IS NOT NULL")
def _(spark, d):
    return table(spark, d, "raw_examples").where("payload is not null").select("raw_id", F.sha2("payload", 256).alias("digest"))


@query("snk06_file_checksums")
def _(spark, d):
    """Every table file of the folder."""
    return sinks.checksums(spark, d, "*.parquet").select("name", "digest")


@query("snk09_split_folders", " UNION ALL ".join(f"SELECT '{s}' AS split, count(DISTINCT idx) AS n_rows FROM {t}" for s, t in inputs.SPLITS.items()))
def _(spark, d):
    path = _path(spark, "splits")
    sinks.write_splits(inputs.all_examples(spark, d).select("split", "idx", "tokens", "tags"), path)
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n_rows"))


_F1 = ratio("2 * tp", "2 * tp + fp + fn")


@query("rpt03_runs", f"WITH {SCORES}, r AS (SELECT model, max({_F1}) FILTER (label = 'PER') AS f1 FROM sc WHERE model LIKE 'encoder%' GROUP BY model) SELECT count(*) AS runs, round(avg(f1), 6) AS mean_f1, round(CASE WHEN count(*) > 1 THEN stddev_samp(f1) ELSE 0.0 END, 6) AS std_f1 FROM r")
def _(spark, d):
    """A summary document with a list of runs, read back and averaged."""
    s = metrics.scored(metrics.span_counts(inputs.spanned(spark, d), ["model"])).where("label = 'PER'")
    doc = s.agg(F.to_json(F.struct(F.collect_list(F.struct("model", "f1")).alias("runs"))).alias("doc"))
    runs = doc.select(F.explode(F.from_json("doc", "runs array<struct<model:string,f1:double>>").getField("runs")).alias("r")).where(F.col("r.model").startswith("encoder"))
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("r.f1"), 6).alias("mean_f1"), F.round(F.coalesce(F.stddev_samp("r.f1"), F.lit(0.0)), 6).alias("std_f1"))


def _cell(x: str, null: str) -> str:
    return f"coalesce(printf('%.4f', {x}), '{null}')"


#: The rows of a text report as (position, lines); the table has a head of two lines.
_ROWS = f"WITH {SCORES}, x AS (SELECT model, label, tp, fp, fn, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, {_F1} AS f1, row_number() OVER (ORDER BY model, label) - 1 AS k FROM sc)"


@query("rpt02_markdown", f"""{_ROWS} SELECT 0 AS line_no, '| model | label | tp | fp | fn | precision | recall | f1 |' AS line UNION ALL SELECT 1, '|{'---|' * 8}'
    UNION ALL SELECT CAST(k + 2 AS INT), '| ' || concat_ws(' | ', model, label, tp, fp, fn, {', '.join(_cell(c, '–') for c in ('precision', 'recall', 'f1'))}) || ' |' FROM x""")
def _(spark, d):
    s = metrics.scored(metrics.span_counts(inputs.spanned(spark, d), ["model"])).orderBy("model", "label")
    return reports.as_lines(spark, reports.markdown_table(s))


_WIDE = ", ".join(f"greatest({len(c)}, (SELECT max(length({c})) FROM y)) AS w_{c}" for c in ("model", "label", "precision", "recall", "f1"))


@query("rpt05_ascii", f"""{_ROWS}, y AS (SELECT k + 1 AS k, model, label, {', '.join(f"{_cell(c, '-')} AS {c}" for c in ('precision', 'recall', 'f1'))} FROM x UNION ALL SELECT 0, 'model', 'label', 'precision', 'recall', 'f1'), w AS (SELECT {_WIDE})
    SELECT CAST(k AS INT) AS line_no, rtrim(rpad(model, CAST(w_model AS INT), ' ') || '  ' || rpad(label, CAST(w_label AS INT), ' ') || '  ' || rpad(precision, CAST(w_precision AS INT), ' ') || '  ' || rpad(recall, CAST(w_recall AS INT), ' ') || '  ' || f1) AS line FROM y, w""")
def _(spark, d):
    s = metrics.scored(metrics.span_counts(inputs.spanned(spark, d), ["model"])).select("model", "label", "precision", "recall", "f1").orderBy("model", "label")
    return reports.as_lines(spark, reports.ascii_table(s))


@query("err05_markdown", f"""WITH {ERR}, x AS (SELECT *, row_number() OVER (ORDER BY model) - 1 AS k FROM bk) SELECT 0 AS line_no, '| model | fn_per | fn_email | fp_per | fp_email | total_errors |' AS line UNION ALL SELECT 1, '|{'---|' * 6}'
    UNION ALL SELECT CAST(k + 2 AS INT), '| ' || concat_ws(' | ', model, fn_per, fn_email, fp_per, fp_email, total_errors) || ' |' FROM x""")
def _(spark, d):
    b = errors.buckets(errors.instances(inputs.spanned(spark, d, True))).orderBy("model")
    return reports.as_lines(spark, reports.markdown_table(b))


@query("stream_scores", f"WITH {SCORES} SELECT model, label, tp, fp, fn, {_F1} AS f1 FROM sc WHERE model LIKE 'encoder%'")
def _(spark, d):
    """The encoder predictions, repeated and late runs among them, as a stream of files, scored batch by batch."""
    rows = stage(table(spark, d, "encoder_predictions").repartition(8), "stream-input")
    out = scorer.run_incremental(spark, rows.inputFiles()[0].rsplit("/", 1)[0])
    return scorer.running_scores(spark, out).select("model", "label", "tp", "fp", "fn", "f1")
