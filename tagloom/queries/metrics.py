"""Queries MET-*, ERR-*, MSK-* and BST-*: scores, errors, masking and resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import bio
from tagloom.operators import bootstrap, errors, inputs, masking, metrics
from tagloom.plans.staging import stage
from tagloom.queries.sql import ERR, MATCHED, PRED, SCORES, SPANS, ratio, spans_of

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


F1 = ratio("2 * tp", "2 * tp + fp + fn")


@query("met01_span_scores", f"WITH {SCORES} SELECT model, label, tp, fp, fn, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, {F1} AS f1 FROM sc")
def _(spark, d):
    return metrics.scored(metrics.span_counts(inputs.spanned(spark, d), ["model"]))


@query("met02_macro", f"WITH {SCORES} SELECT model, round(avg({F1}), 6) AS macro_f1 FROM sc GROUP BY model")
def _(spark, d):
    return metrics.macro(metrics.scored(metrics.span_counts(inputs.spanned(spark, d), ["model"])), ["model"])


_LOOSE = PRED + "".join(
    f", {n}r AS (SELECT model, idx, list_transform({c}, lambda t, i: CASE WHEN t LIKE 'I-%' AND (i = 1 OR {c}[i - 1] = 'O' OR substr({c}[i - 1], 3) <> substr(t, 3)) THEN 'B-' || substr(t, 3) ELSE t END) AS tags FROM pred), {spans_of(n, n + 'r', 'model, idx', 'tags')}"
    for n, c in (("lg", "gold"), ("lp", "pred"))
)


@query(
    "met03_micro",
    f"""WITH {_LOOSE}, c AS (SELECT model, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM (
      SELECT coalesce(lg.model, lp.model) AS model, lg.s IS NOT NULL AS g, lp.s IS NOT NULL AS p FROM lg FULL OUTER JOIN lp ON lg.model = lp.model AND lg.idx = lp.idx AND lg.s = lp.s AND lg.e = lp.e AND lg.label = lp.label) GROUP BY model)
    SELECT model, tp, fp, fn, {F1} AS micro_f1 FROM c""",
)
def _(spark, d):
    rows = inputs.predictions(spark, d).withColumns({"gold_spans": bio.loose_spans("gold"), "pred_spans": bio.loose_spans("pred")})
    c = metrics.span_counts(rows, ["model"]).groupBy("model").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    return c.withColumn("micro_f1", bio.f1(F.col("tp"), F.col("fp"), F.col("fn")))


@query(
    "met04_overall",
    f"""WITH {SCORES}, x AS (SELECT model, max({F1}) FILTER (label = 'PER') AS per_f1, max({F1}) FILTER (label = 'EMAIL') AS email_f1, coalesce(max(tp + fn) FILTER (label = 'EMAIL'), 0) AS n FROM sc GROUP BY model)
    SELECT model, per_f1, CASE WHEN n > 0 THEN email_f1 END AS email_f1, round(CASE WHEN n > 0 THEN (per_f1 + email_f1) / 2 ELSE per_f1 END, 6) AS overall_f1 FROM x""",
)
def _(spark, d):
    """Without any gold e-mail, its score is null and the overall one is that of persons."""
    s = metrics.scored(metrics.span_counts(inputs.spanned(spark, d), ["model"]))
    of = lambda c, k: F.max(F.when(F.col("label") == k, F.col(c)))
    x = s.withColumn("n", F.col("tp") + F.col("fn")).groupBy("model").agg(of("f1", "PER").alias("per_f1"), of("f1", "EMAIL").alias("e"), F.coalesce(of("n", "EMAIL"), F.lit(0)).alias("n"))
    mail = F.when(F.col("n") > 0, F.col("e"))
    return x.select("model", "per_f1", mail.alias("email_f1"), F.round(F.when(F.col("n") > 0, (F.col("per_f1") + F.col("e")) / 2).otherwise(F.col("per_f1")), 6).alias("overall_f1"))


def _token_sql(test: str, name: str) -> str:
    g, p = test.format(t="g.tag"), test.format(t="pred[g.pos]")
    return f"""SELECT model, '{name}' AS kind, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn
      FROM (SELECT model, {g} AS g, {p} AS p FROM pred, unnest(pred.gold) WITH ORDINALITY AS g(tag, pos)) GROUP BY model"""


_RATES = f"kind, model, tp, fp, fn, tn, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, {F1} AS f1, {ratio('fp', 'fp + tn')} AS fpr, {ratio('fn', 'fn + tp')} AS fnr"
_TESTS = {"met05": {"PER": lambda t: F.contains(t, F.lit("PER")), "EMAIL": lambda t: F.contains(t, F.lit("EMAIL"))},
          "met06": {"PER": lambda t: t.isin("B-PER", "I-PER"), "EMAIL": lambda t: t.isin("B-EMAIL", "I-EMAIL")}, "met07": {"ANY": lambda t: t != "O"}}
_SQL = {"met05": {k: f"contains({{t}}, '{k}')" for k in ("PER", "EMAIL")}, "met06": {k: f"{{t}} IN ('B-{k}', 'I-{k}')" for k in ("PER", "EMAIL")}, "met07": {"ANY": "{t} <> 'O'"}}
for _key, _name in (("met05", "met05_token_substring"), ("met06", "met06_token_rates"), ("met07", "met07_token_any")):

    def _tokens(spark, d, tests=_TESTS[_key]):
        rows = inputs.predictions(spark, d)
        each = [metrics.token_counts(rows, ["model"], t).withColumn("kind", F.lit(k)) for k, t in tests.items()]
        return metrics.token_rates(reduce(DataFrame.unionByName, each))

    query(_name, f"WITH {PRED}, c AS ({' UNION ALL '.join(_token_sql(t, k) for k, t in _SQL[_key].items())}) SELECT {_RATES} FROM c")(_tokens)


@query(
    "met08_span_leak",
    f"""WITH {SPANS}, l AS (SELECT gs.model, list_contains(pred.pred[gs.s + 1:gs.e], 'O') AS leak FROM gs JOIN pred USING (model, idx))
    SELECT model, count(*) FILTER (leak) AS leaked, count(*) AS spans, {ratio('count(*) FILTER (leak)', 'count(*)')} AS span_leak_rate FROM l GROUP BY model""",
)
def _(spark, d):
    rows = metrics.leaked_spans(inputs.spanned(spark, d)).groupBy("model").agg(F.sum("leaked").alias("leaked"), F.sum(F.size("gold_spans")).alias("spans")).where("spans > 0")
    return rows.withColumn("span_leak_rate", bio.ratio(F.col("leaked"), F.col("spans")))


def _located_sql(rows: str) -> str:
    """Masking of stored texts: tokens are searched one after the other by recursion, spans become pieces of text."""
    return f"""WITH RECURSIVE {PRED}, r AS ({rows}), {spans_of('sp', 'r', 'model, idx', 'tags')},
    loc AS (SELECT model, idx, 0 AS k, CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b FROM r UNION ALL
      SELECT model, idx, k + 1, CASE WHEN i > 0 THEN pos + i - 1 + length(tok) ELSE pos END, CASE WHEN i > 0 THEN pos + i - 1 ELSE -1 END, CASE WHEN i > 0 THEN pos + i - 1 + length(tok) ELSE -1 END
      FROM (SELECT loc.model, loc.idx, k, pos, r.tokens[k + 1] AS tok, strpos(substr(r.sequence, pos + 1), r.tokens[k + 1]) AS i FROM loc JOIN r USING (model, idx) WHERE k < len(r.tokens))),
    cr AS (SELECT sp.model, sp.idx, sp.s, any_value(sp.label) AS label, max(loc.a) FILTER (loc.k = sp.s + 1) AS a, max(loc.b) AS b FROM sp JOIN loc ON loc.model = sp.model AND loc.idx = sp.idx AND loc.k > sp.s AND loc.k <= sp.e GROUP BY ALL),
    ok AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY model, idx ORDER BY s), 0) AS from_ FROM cr WHERE a >= 0 AND b >= 0),
    pc AS (SELECT ok.model, ok.idx, string_agg(substr(r.sequence, from_ + 1, a - from_) || CASE label WHEN 'PER' THEN '[NAME]' ELSE '[' || label || ']' END, '' ORDER BY s) AS head, max(b) AS last, count(*) AS n FROM ok JOIN r USING (model, idx) GROUP BY ALL),
    mk AS (SELECT r.model, r.idx, r.sequence, coalesce(pc.head, '') || substr(r.sequence, coalesce(pc.last, 0) + 1) AS masked, coalesce(pc.n, 0) AS n FROM r LEFT JOIN pc USING (model, idx))"""


#: The stored texts of all records; where tags and tokens differ in number nothing is masked.
_STORED = _located_sql("SELECT model, idx, coalesce(sequence, array_to_string(tokens, ' ')) AS sequence, sequence IS NULL AS rebuilt, tokens, gold, CASE WHEN len(pred) = len(tokens) THEN pred ELSE pred[1:0] END AS tags FROM pred")
_BATCH = _located_sql(
    "SELECT model, idx, CASE WHEN coalesce(sequence, '') = '' THEN array_to_string(tokens, ' ') ELSE sequence END AS sequence, tokens, "
    "list_slice(list_concat(coalesce(raw_pred, []), list_transform(range(len(tokens)), lambda x: 'O')), 1, len(tokens)) AS tags FROM pred"
)


def _masked(spark, d) -> DataFrame:
    """Every record with its stored text masked; a missing text is rebuilt, tags that do not fit the tokens mask nothing."""
    return masking.masked(masking.with_sequence(inputs.spanned(spark, d, True)), strict=False)


@query("msk01_03_masked", f"{_STORED} SELECT model, idx, masked FROM mk")
def _(spark, d):
    return _masked(spark, d).select("model", "idx", "masked")


@query(
    "msk02_unlocated",
    f"""{_STORED}, ns AS (SELECT model, count(*) AS n FROM sp GROUP BY model), x AS (SELECT mk.model, count(*) AS n_rows, CAST(sum(mk.n) AS BIGINT) AS found, count(*) FILTER (r.rebuilt) AS n_rebuilt, count(*) FILTER (mk.masked <> mk.sequence) AS n_changed FROM mk JOIN r USING (model, idx) GROUP BY mk.model)
    SELECT model, n_rows, coalesce(ns.n, 0) - found AS n_unlocated, n_rebuilt, n_changed FROM x LEFT JOIN ns USING (model)""",
)
def _(spark, d):
    """Masking of the stored texts: spans whose first token is not in the text stay, and are counted."""
    return _masked(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_unlocated").alias("n_unlocated"), F.count_if(F.col("rebuilt")).alias("n_rebuilt"), F.count_if(F.col("masked") != F.col("sequence")).alias("n_changed"))


@query("msk04_length_mismatch", f"WITH {PRED} SELECT model, idx, len(coalesce(raw_pred, [])) AS n_pred, len(tokens) AS n_tokens FROM pred WHERE len(coalesce(raw_pred, [])) <> len(tokens)")
def _(spark, d):
    rows = inputs.predictions(spark, d, True).withColumn("n_pred", F.size(bio.present("raw_pred")).cast("long"))
    return rows.where(F.col("n_pred") != F.size("tokens")).select("model", "idx", "n_pred", F.size("tokens").cast("long").alias("n_tokens"))


@query("msk05_batch", f"{_BATCH} SELECT model, idx, masked FROM mk")
def _(spark, d):
    """Every record with its masked text; predictions padded to the tokens, a missing or empty text rebuilt."""
    rows = inputs.predictions(spark, d, True).withColumn("pred", bio.padded("raw_pred", "tokens"))
    rows = masking.with_sequence(rows, True).withColumn("pred_spans", bio.spans("pred"))
    return masking.masked(rows).select("model", "idx", "masked")


_TRIM = " || ".join(f"chr({ord(c)})" for c in masking.BLANKS)


@query(
    "met09_sentence_leak",
    f"""{_STORED}, {spans_of('gs', 'r', 'model, idx', 'gold')},
    l AS (SELECT mk.model, mk.idx, coalesce(bool_or(ent <> '' AND contains(lower(mk.masked), ent)), false) AS leak
      FROM mk LEFT JOIN (SELECT gs.model, gs.idx, lower(trim(array_to_string(r.tokens[gs.s + 1:gs.e], ' '), {_TRIM})) AS ent FROM gs JOIN r USING (model, idx)) g USING (model, idx) GROUP BY ALL)
    SELECT model, count(*) FILTER (leak) AS leaked, count(*) AS sentences, {ratio('count(*) FILTER (leak)', 'count(*)')} AS sentence_leak_rate FROM l GROUP BY model""",
)
def _(spark, d):
    """Over all records and their stored texts."""
    c = masking.leaks(_masked(spark, d)).groupBy("model").agg(F.count_if("leaks").alias("leaked"), F.count(F.lit(1)).alias("sentences"))
    return c.withColumn("sentence_leak_rate", bio.ratio(F.col("leaked"), F.col("sentences")))


@query("met10_parse_failures", f"WITH l AS (SELECT DISTINCT ON (idx) idx, parse_ok FROM llm_predictions WHERE idx IS NOT NULL ORDER BY idx) SELECT count(*) AS n, count(*) FILTER (NOT coalesce(parse_ok, true)) AS failed_lenient, count(*) FILTER (NOT coalesce(parse_ok, false)) AS failed_strict, {ratio('count(*) FILTER (NOT coalesce(parse_ok, true))', 'count(*)')} AS failure_rate FROM l")
def _(spark, d):
    """A missing flag means success in the lenient count, failure in the strict one."""
    bad = lambda x: F.count_if(~F.coalesce("parse_ok", F.lit(x)))
    return inputs.llm_predictions(spark, d).agg(F.count(F.lit(1)).alias("n"), bad(True).alias("failed_lenient"), bad(False).alias("failed_strict"), bio.ratio(bad(True), F.count(F.lit(1))).alias("failure_rate"))


_SENT = (
    MATCHED
    + f""", sl AS (SELECT model, idx, label, count(*) FILTER (in_gold AND in_pred) AS tp, count(*) FILTER (in_pred AND NOT in_gold) AS fp, count(*) FILTER (in_gold AND NOT in_pred) AS fn FROM m GROUP BY ALL),
  sf AS (SELECT pred.model, pred.idx, coalesce(avg(2.0 * tp / (2 * tp + fp + fn)), 0.0) AS f1 FROM pred LEFT JOIN sl USING (model, idx) GROUP BY ALL)"""
)


@query("met11_sentence_f1", f"WITH {_SENT} SELECT model, idx, round(f1, 6) AS f1 FROM sf")
def _(spark, d):
    return metrics.sentence_f1(inputs.spanned(spark, d)).select("model", "idx", F.round("f1", 6).alias("f1"))


def _late_sql(side: str, kind: str) -> str:
    """Blocks end with a closer; a block's span runs from its last ``B-X`` to its closer."""
    closer = f"(tag = 'O' OR (tag LIKE 'B-%' AND tag <> 'B-{kind}'))"
    return f"""SELECT model, idx, '{side}' AS side, '{kind}' AS label, max(pos) FILTER (tag = 'B-{kind}') AS s, coalesce(max(pos) FILTER ({closer}), max(pos) + 1) AS e FROM (
      SELECT model, idx, pos, tag, coalesce(sum(CASE WHEN {closer} THEN 1 ELSE 0 END) OVER (PARTITION BY model, idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM (
        SELECT pred.model, pred.idx, u.pos - 1 AS pos, u.tag FROM pred, unnest(pred.{side}) WITH ORDINALITY AS u(tag, pos))) GROUP BY model, idx, block HAVING max(pos) FILTER (tag = 'B-{kind}') IS NOT NULL"""


_LATE = PRED + ", ls AS (" + " UNION ALL ".join(_late_sql(side, kind) for side in ("gold", "pred") for kind in ("PER", "EMAIL")) + """),
  lm AS (SELECT model, idx, label, s, e, bool_or(side = 'gold') AS g, bool_or(side = 'pred') AS p FROM ls GROUP BY ALL),
  ll AS (SELECT model, idx, label, 2.0 * count(*) FILTER (g AND p) / (count(*) FILTER (g) + count(*) FILTER (p)) AS f1 FROM lm GROUP BY ALL)"""


@query("met12_late_sentence_f1", f"WITH {_LATE} SELECT pred.model, pred.idx, round(coalesce(avg(ll.f1), 0.0), 6) AS f1 FROM pred LEFT JOIN ll USING (model, idx) GROUP BY ALL")
def _(spark, d):
    return metrics.late_sentence_f1(inputs.predictions(spark, d)).select("model", "idx", F.round("f1", 6).alias("f1"))


@query(
    "met17_seed_spread",
    f"""WITH {SCORES}, s AS (SELECT label, {F1} AS f1 FROM sc WHERE model LIKE 'encoder%') SELECT label, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_pop, round(CASE WHEN count(*) > 1 THEN stddev_samp(f1) ELSE 0.0 END, 6) AS std_samp FROM s GROUP BY label""",
)
def _(spark, d):
    s = metrics.scored(metrics.span_counts(inputs.spanned(spark, d).where(F.col("model").startswith("encoder")), ["model"]))
    return s.groupBy("label").agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.stddev_pop("f1"), 6).alias("std_pop"), F.round(F.coalesce(F.stddev_samp("f1"), F.lit(0.0)), 6).alias("std_samp"))


# ---------------------------------------------------------------- errors

def _errors(spark, d) -> DataFrame:
    return errors.instances(inputs.spanned(spark, d, True))


@query("err01_buckets", f"WITH {ERR} SELECT * FROM bk")
def _(spark, d):
    return errors.buckets(_errors(spark, d))


@query("err02_shares", f"WITH {ERR} SELECT model, total_errors, {', '.join(f'round(100.0 * {b.lower()} / total_errors, 2) AS {b.lower()}_pct' for b in errors.BUCKETS)} FROM bk")
def _(spark, d):
    b = errors.buckets(_errors(spark, d))
    pct = [F.round(F.coalesce(F.try_divide(100.0 * F.col(x.lower()), F.col("total_errors")), F.lit(0.0)), 2).alias(f"{x.lower()}_pct") for x in errors.BUCKETS]
    return b.select("model", "total_errors", *pct)


@query("err03_instances", f"WITH {ERR} SELECT model, idx, error_type, s, e, text FROM er")
def _(spark, d):
    return _errors(spark, d).select("model", "idx", "error_type", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "text")


@query("err04_sheet_rows", f"WITH {ERR} SELECT model AS approach, idx AS sentence_idx, tokens, error_type, CASE WHEN error_type LIKE 'FN%' THEN text ELSE '' END AS gold_span, CASE WHEN error_type LIKE 'FP%' THEN text ELSE '' END AS pred_span, 'MANUAL_TODO' AS sub_label, '' AS notes FROM er")
def _(spark, d):
    return errors.sheet(_errors(spark, d))


@query("err05_pivot", f"WITH {ERR}, l AS (SELECT model, error_type, count(*) AS n FROM er GROUP BY ALL) SELECT error_type, coalesce(max(n) FILTER (model = 'encoder_a'), 0) AS encoder_a, coalesce(max(n) FILTER (model = 'encoder_b'), 0) AS encoder_b, coalesce(max(n) FILTER (model = 'llm'), 0) AS llm FROM l GROUP BY error_type")
def _(spark, d):
    return _errors(spark, d).groupBy("error_type").pivot("model", ["encoder_a", "encoder_b", "llm"]).agg(F.count(F.lit(1))).na.fill(0)


@query("snk08_bucket_chart_data", f"WITH {ERR} SELECT model, error_type AS bucket, count(*) AS n FROM er GROUP BY ALL")
def _(spark, d):
    return _errors(spark, d).groupBy("model", F.col("error_type").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_QUOTA = "CAST(greatest(1, round_even(n / CAST(sum(n) OVER (PARTITION BY model) AS DOUBLE) * 30, 0)) AS INT)"


_QUOTAS = f"""WITH RECURSIVE {ERR}, n AS (SELECT model, error_type, count(*) AS n FROM er GROUP BY ALL),
    q0 AS (SELECT model, error_type, n, {_QUOTA} AS quota, list_position(['FN_PER', 'FN_EMAIL', 'FP_PER', 'FP_EMAIL'], error_type) AS o FROM n),
    q AS (SELECT 0 AS step, * FROM q0 UNION ALL
      SELECT step + 1, model, error_type, n, CASE WHEN total > 30 AND top > 1 AND row_number() OVER (PARTITION BY model ORDER BY quota DESC, o) = 1 THEN quota - 1 ELSE quota END, o
      FROM (SELECT *, sum(quota) OVER (PARTITION BY model) AS total, max(quota) OVER (PARTITION BY model) AS top FROM q) WHERE step < 4)"""


@query("smp01_quotas", f"{_QUOTAS} SELECT model, error_type, n, quota FROM q WHERE step = 4")
def _(spark, d):
    return errors.quotas(_errors(spark, d))


@query("smp01_sample_sizes", f"{_QUOTAS} SELECT model, error_type, least(n, quota) AS n FROM q WHERE step = 4")
def _(spark, d):
    """The drawn errors by bucket, in the order of a portable hash of the place."""
    rank = bootstrap.portable(F.col("idx") * 31 + F.col("s"), 42)
    return errors.sampled(_errors(spark, d), rank).groupBy("model", "error_type").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- bootstrap

_PAIRS = _SENT + """, pr AS (SELECT a.model AS encoder, a.idx, a.f1 AS fa, b.f1 AS fb, row_number() OVER (PARTITION BY a.model ORDER BY a.idx) - 1 AS k, count(*) OVER (PARTITION BY a.model) AS n
  FROM sf a JOIN sf b ON a.idx = b.idx AND b.model = 'llm' WHERE a.model LIKE 'encoder%')"""


@query("bst01_pairs", f"WITH {_PAIRS} SELECT encoder, idx, round(fa, 6) AS fa, round(fb, 6) AS fb FROM pr")
def _(spark, d):
    return _all_pairs(spark, d).select("encoder", "idx", F.round("fa", 6).alias("fa"), F.round("fb", 6).alias("fb"))


@query("bst02_strict_pairing", f"WITH {_SENT}, c AS (SELECT count(*) FILTER (model = 'encoder_a') AS n_a, count(*) FILTER (model = 'llm') AS n_b FROM sf) SELECT n_a, n_b, n_a = n_b AS pairs FROM c")
def _(spark, d):
    """Row counts of both sides; ``bootstrap.strict_pairs`` refuses unequal ones."""
    p = inputs.predictions(spark, d)
    return p.agg(F.count_if(F.col("model") == "encoder_a").alias("n_a"), F.count_if(F.col("model") == "llm").alias("n_b")).withColumn("pairs", F.col("n_a") == F.col("n_b"))


_BOOT = (
    _PAIRS
    + f""", bs AS (SELECT q.encoder, b, avg(fa - fb) AS diff FROM (SELECT p.encoder, r.b, {bootstrap.PORTABLE_SQL.format(x='(r.b * 1000003 + p.k)', salt=42)} % p.n AS pick FROM range({bootstrap.RESAMPLES}) r(b), pr p) q
    JOIN pr ON pr.encoder = q.encoder AND pr.k = q.pick GROUP BY q.encoder, b)"""
)
_LINEAR = "round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high"
_P = "p AS (SELECT encoder, avg(CASE WHEN diff <= 0 THEN 1.0 ELSE 0.0 END) AS p, count(*) AS b FROM bs GROUP BY encoder)"
_SHOWN = "round(p, 6) AS p_value, CASE WHEN p = 0 THEN '<1/' || b ELSE CAST(round(p, 6) AS VARCHAR) END AS shown, CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END AS reading"


_BY = ("encoder",)


def _all_pairs(spark, d) -> DataFrame:
    """(encoder, idx, fa, fb) of every encoder against llm."""
    f = metrics.sentence_f1(inputs.spanned(spark, d)).select("model", "idx", "f1")
    e = f.where(F.col("model").startswith("encoder")).select(F.col("model").alias("encoder"), "idx", F.col("f1").alias("fa"))
    return e.join(f.where("model = 'llm'").select("idx", F.col("f1").alias("fb")), "idx")


def _resampled(spark, d) -> DataFrame:
    return bootstrap.resampled(_all_pairs(spark, d), bootstrap.RESAMPLES, 42, _BY)


def _linear_interval() -> list:
    return [F.round(F.percentile("diff", F.lit(q)), 6).alias(name) for name, q in (("low", 0.025), ("high", 0.975))]


def _p_value(diffs: DataFrame, *more) -> DataFrame:
    """(encoder, p_value, shown, reading) and what ``more`` aggregates."""
    p = diffs.groupBy(*_BY).agg(F.avg(F.when(F.col("diff") <= 0, 1.0).otherwise(0.0)).alias("p"), F.count(F.lit(1)).alias("resamples"), *more)
    shown = F.when(F.col("p") == 0, F.concat(F.lit("<1/"), F.col("resamples").cast("string"))).otherwise(F.round("p", 6).cast("string"))
    reading = F.when(F.col("p") < 0.05, "significant").otherwise("not significant")
    return p.withColumns({"p_value": F.round("p", 6), "shown": shown, "reading": reading}).drop("p")


@query("bst03_resamples", f"WITH {_BOOT} SELECT encoder, b, round(diff, 6) AS diff FROM bs")
def _(spark, d):
    return _resampled(spark, d).select("encoder", "b", F.round("diff", 6).alias("diff"))


@query("bst04_linear_interval", f"WITH {_BOOT} SELECT encoder, {_LINEAR} FROM bs GROUP BY encoder")
def _(spark, d):
    return _resampled(spark, d).groupBy(*_BY).agg(*_linear_interval())


@query("bst05_index_interval", f"WITH {_BOOT}, r AS (SELECT encoder, diff, row_number() OVER (PARTITION BY encoder ORDER BY diff) - 1 AS k, count(*) OVER (PARTITION BY encoder) AS n FROM bs) SELECT encoder, round(max(diff) FILTER (k = CAST(floor(0.025 * n) AS BIGINT)), 6) AS low, round(max(diff) FILTER (k = CAST(floor(0.975 * n) AS BIGINT)), 6) AS high FROM r GROUP BY encoder")
def _(spark, d):
    return bootstrap.index_interval(_resampled(spark, d), _BY)


@query("bst06_p_value", f"WITH {_BOOT}, {_P} SELECT encoder, {_SHOWN} FROM p")
def _(spark, d):
    return _p_value(_resampled(spark, d)).select("encoder", "p_value", "shown", "reading")


@query(
    "bst07_all_pairs",
    f"""WITH {_BOOT}, {_P}, i AS (SELECT encoder, {_LINEAR} FROM bs GROUP BY encoder),
    n AS (SELECT encoder, round(avg(fa), 6) AS encoder_f1, round(avg(fb), 6) AS llm_f1, round(avg(fa - fb), 6) AS diff, count(*) AS n FROM pr GROUP BY encoder)
    SELECT n.*, i.low, i.high, p.b AS resamples, {_SHOWN} FROM n JOIN i USING (encoder) JOIN p USING (encoder)""",
)
def _(spark, d):
    """Means, interval and p of every encoder against llm."""
    j = stage(_all_pairs(spark, d), "bootstrap-scores")
    means = j.groupBy("encoder").agg(F.round(F.avg("fa"), 6).alias("encoder_f1"), F.round(F.avg("fb"), 6).alias("llm_f1"), F.round(F.avg(F.col("fa") - F.col("fb")), 6).alias("diff"), F.count(F.lit(1)).alias("n"))
    return means.join(_p_value(bootstrap.resampled(j, bootstrap.RESAMPLES, 42, _BY), *_linear_interval()), "encoder")


# ---------------------------------------------------------------- reports

@query(
    "rpt01_results",
    f"""WITH {SCORES}, s AS (SELECT model, max({F1}) FILTER (label = 'PER') AS per_f1, max({F1}) FILTER (label = 'EMAIL') AS email_f1, round(avg({F1}), 6) AS macro_f1 FROM sc GROUP BY model)
    SELECT CASE WHEN model LIKE 'encoder%' THEN 'encoder' ELSE model END AS family, count(*) AS models, round(avg(per_f1), 6) AS per_mean, round(stddev_pop(per_f1), 4) AS per_std, round(avg(email_f1), 6) AS email_mean,
      round(avg(macro_f1), 6) AS macro_mean, string_agg(model, ',' ORDER BY model) AS model_list FROM s GROUP BY ALL""",
)
def _(spark, d):
    s = metrics.scored(metrics.span_counts(inputs.spanned(spark, d), ["model"]))
    of = lambda k: F.max(F.when(F.col("label") == k, F.col("f1")))
    w = s.groupBy("model").agg(of("PER").alias("per_f1"), of("EMAIL").alias("email_f1"), F.round(F.avg("f1"), 6).alias("macro_f1"))
    family = F.when(F.col("model").startswith("encoder"), "encoder").otherwise(F.col("model"))
    return w.groupBy(family.alias("family")).agg(
        F.count(F.lit(1)).alias("models"), F.round(F.avg("per_f1"), 6).alias("per_mean"), F.round(F.stddev_pop("per_f1"), 4).alias("per_std"), F.round(F.avg("email_f1"), 6).alias("email_mean"),
        F.round(F.avg("macro_f1"), 6).alias("macro_mean"), F.array_join(F.array_sort(F.collect_list("model")), ",").alias("model_list"),
    )


@query(
    "rpt04_summary",
    f"""WITH {SCORES}, s AS (SELECT model, max({F1}) FILTER (label = 'PER') AS per_f1, max({F1}) FILTER (label = 'EMAIL') AS email_f1 FROM sc GROUP BY model)
    SELECT CASE model WHEN 'encoder_a' THEN 'A' WHEN 'encoder_b' THEN 'B' ELSE 'C' END AS approach, model, per_f1, email_f1 FROM s""",
)
def _(spark, d):
    s = metrics.scored(metrics.span_counts(inputs.spanned(spark, d), ["model"]))
    of = lambda k: F.max(F.when(F.col("label") == k, F.col("f1")))
    label = F.when(F.col("model") == "encoder_a", "A").when(F.col("model") == "encoder_b", "B").otherwise("C")
    return s.groupBy(label.alias("approach"), "model").agg(of("PER").alias("per_f1"), of("EMAIL").alias("email_f1"))


@query("rpt06_model_table", f"WITH {SCORES}, s AS (SELECT model, label, {F1} AS f1 FROM sc) SELECT row_number() OVER (ORDER BY model, label) AS row_no, model, label, f1 FROM s")
def _(spark, d):
    s = metrics.scored(metrics.span_counts(inputs.spanned(spark, d), ["model"])).select("model", "label", "f1")
    return s.withColumn("row_no", F.row_number().over(Window.orderBy("model", "label")).cast("long"))  # a few rows a model
