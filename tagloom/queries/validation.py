"""Queries VAL-*, PRJ-* and the profile metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import bio
from tagloom.operators import inputs, validation
from tagloom.queries.sql import ALL_EX, PRED, SPANS, ex, spans_of
from tagloom.plans.staging import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_KIND = "CASE WHEN {t} <> 'O' THEN substr({t}, 3) ELSE '' END"
STATUS = f"""u AS (SELECT ex.*, array_to_string(list_sort(list_distinct(list_filter(tags, lambda t: t NOT IN ('O','B-PER','I-PER','B-EMAIL','I-EMAIL')))), ',') AS unknown FROM ex),
st AS (SELECT *, CASE WHEN len(tokens) <> len(tags) THEN 'length_mismatch' WHEN unknown <> '' THEN 'unknown_tags'
  WHEN len(tokens) = 0 OR list_contains(tokens, '') THEN 'empty_token' WHEN lang IS DISTINCT FROM 'en' THEN 'non_english' ELSE 'valid' END AS status FROM u),
tg AS (SELECT st.idx, st.lang, st.status, x.pos - 1 AS pos, x.tag, {_KIND.format(t="x.tag")} AS kind FROM st, unnest(st.tags) WITH ORDINALITY AS x(tag, pos)),
lg AS (SELECT *, lag(kind) OVER (PARTITION BY idx ORDER BY pos) AS before FROM tg),
orp AS (SELECT *, tag LIKE 'I-%' AND before IS DISTINCT FROM kind AS orphan FROM lg),
fx AS (SELECT idx, status, lang, string_agg(CASE WHEN orphan THEN 'B-' || kind ELSE tag END, ' ' ORDER BY pos) AS fixed, count(*) FILTER (orphan) AS n_fixes FROM orp GROUP BY ALL)"""


@query("val01_03_status", f"WITH {ex()}, {STATUS} SELECT idx, status, unknown FROM st WHERE status IN ('length_mismatch', 'unknown_tags', 'empty_token')")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = validation.status(inputs.examples(spark, d))
    return rows.where("status in ('length_mismatch', 'unknown_tags', 'empty_token')").select("idx", "status", F.array_join("unknown", ",").alias("unknown"))


@query("val04_repair", f"WITH {ex()}, {STATUS} SELECT idx, fixed, n_fixes FROM fx")
def _(spark, d):
    e = inputs.examples(spark, d).where(F.size("tags") > 0)
    return e.select("idx", F.array_join(bio.repair("tags"), " ").alias("fixed"), F.size(bio.orphans("tags")).cast("long").alias("n_fixes"))


@query("val05_language", f"WITH {ex()}, {STATUS} SELECT idx, lang FROM st WHERE status = 'non_english'")
def _(spark, d):
    return validation.status(inputs.examples(spark, d)).where("status = 'non_english'").select("idx", "lang")


@query("val06_fix_log", f"WITH {ex()}, {STATUS} SELECT idx, pos, kind AS entity FROM orp WHERE orphan AND status = 'valid'")
def _(spark, d):
    rows = validation.status(inputs.examples(spark, d)).where("status = 'valid'")
    return rows.select("idx", "tags", F.explode("fixes").alias("pos")).select("idx", F.col("pos").cast("long").alias("pos"), bio.entity(F.get("tags", F.col("pos"))).alias("entity"))


@query("val07_clean", f"""WITH {ex()}, {STATUS} SELECT st.idx, st.sequence, array_to_string(st.tokens, ' ') AS tokens, fx.fixed AS tags FROM st JOIN fx USING (idx) WHERE st.status = 'valid'""")
def _(spark, d):
    return validation.clean(inputs.examples(spark, d)).select("idx", "sequence", F.array_join("tokens", " ").alias("tokens"), F.array_join("tags", " ").alias("tags"))


@query("val07_invalid_idx", f"WITH {ex()}, {STATUS} SELECT status, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM st WHERE status <> 'valid' GROUP BY status")
def _(spark, d):
    rows = validation.status(inputs.examples(spark, d)).where("status <> 'valid'")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("val08_strict", f"WITH {ex()}, {STATUS} SELECT idx, fixed FROM fx WHERE status = 'valid'")
def _(spark, d):
    """The strict check over repaired rows: it passes, or the query fails."""
    rows = validation.clean(inputs.examples(spark, d))
    return validation.verify_strict(rows).select("idx", F.array_join("tags", " ").alias("fixed"))


@query("val09_is_bio", f"WITH {ex()}, {STATUS} SELECT st.idx, coalesce(fx.n_fixes, 0) = 0 AS is_bio FROM st LEFT JOIN fx USING (idx)")
def _(spark, d):
    return inputs.examples(spark, d).select("idx", bio.is_valid_bio("tags").alias("is_bio"))


@query(
    "val11_inspection",
    f"""WITH {ALL_EX}, c AS (SELECT split, idx, len(tokens) AS n, len(list_filter(tags, lambda t: t = 'B-PER')) AS per, len(list_filter(tags, lambda t: t = 'B-EMAIL')) AS mail FROM ex),
    tg AS (SELECT split, idx, x.pos, x.tag, {_KIND.format(t="x.tag")} AS kind FROM ex, unnest(ex.tags) WITH ORDINALITY AS x(tag, pos)),
    fx AS (SELECT split, count(*) FILTER (tag LIKE 'I-%' AND before IS DISTINCT FROM kind) AS fixes FROM (SELECT *, lag(kind) OVER (PARTITION BY split, idx ORDER BY pos) AS before FROM tg) GROUP BY split)
    SELECT c.split, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(per) AS BIGINT) AS per_spans, CAST(sum(mail) AS BIGINT) AS email_spans, any_value(fixes) AS fixes FROM c LEFT JOIN fx ON fx.split = c.split GROUP BY c.split""",
)
def _(spark, d):
    """Fixes count for invalid rows too."""
    return inputs.all_examples(spark, d).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("tokens")).alias("n_tokens"), F.sum(bio.count_spans("tags", "PER")).alias("per_spans"),
        F.sum(bio.count_spans("tags", "EMAIL")).alias("email_spans"), F.sum(F.size(bio.orphans("tags"))).alias("fixes"),
    )


@query("val11_first_violations", f"WITH {ex()}, {STATUS} SELECT idx, status FROM st WHERE status <> 'valid' ORDER BY idx LIMIT 50")
def _(spark, d):
    return validation.status(inputs.examples(spark, d)).where("status <> 'valid'").select("idx", "status").orderBy("idx").limit(50)


@query("val12_email_pattern", rf"SELECT DISTINCT idx, injected_email_str AS email, regexp_matches(injected_email_str, '{validation.EMAIL_PATTERN}') AS ok FROM train_injected WHERE injected_email_str IS NOT NULL")
def _(spark, d):
    t = table(spark, d, "train_injected").where("injected_email_str is not null")
    return t.select("idx", F.col("injected_email_str").alias("email"), F.col("injected_email_str").rlike(validation.EMAIL_PATTERN).alias("ok")).distinct()


@query(
    "prj01_02_spans_bucket",
    f"""WITH {ex()}, c AS (SELECT idx, len(list_filter(tags, lambda t: t = 'B-PER')) AS n_per, len(list_filter(tags, lambda t: t = 'B-EMAIL')) AS n_email FROM ex)
    SELECT idx, n_per, n_email, CASE n_per WHEN 0 THEN 'zero_per' WHEN 1 THEN 'one_per' ELSE 'multi_per' END AS bucket FROM c""",
)
def _(spark, d):
    n = bio.count_spans("tags", "PER").cast("long")
    return inputs.examples(spark, d).select("idx", n.alias("n_per"), bio.count_spans("tags", "EMAIL").cast("long").alias("n_email"), bio.density_bucket(n).alias("bucket"))


@query("prj03_spans", f"WITH {SPANS} SELECT model, idx, s, e, label FROM gs")
def _(spark, d):
    return inputs.spanned(spark, d).select("model", "idx", F.explode("gold_spans").alias("x")).select("model", "idx", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"), "x.label")


@query("prj04_per_spans", f"WITH {ex()}, {spans_of('sp', 'ex', 'idx', 'tags')} SELECT idx, s, e FROM sp WHERE label = 'PER'")
def _(spark, d):
    rows = inputs.examples(spark, d).select("idx", F.explode(bio.spans("tags")).alias("x")).where("x.label = 'PER'")
    return rows.select("idx", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"))


_INTS = "list_transform(tags, lambda t: CASE t WHEN 'O' THEN 0 WHEN 'B-PER' THEN 1 WHEN 'I-PER' THEN 2 WHEN 'B-EMAIL' THEN 3 WHEN 'I-EMAIL' THEN 4 ELSE 9 END)"


@query("prj05_tag_ids", f"WITH {ex()}, i AS (SELECT idx, {_INTS} AS ids FROM ex) SELECT idx, array_to_string(ids, ' ') AS ids, array_to_string(list_transform(ids, lambda i: CASE i WHEN 1 THEN 'B-PER' WHEN 2 THEN 'I-PER' WHEN 3 THEN 'B-EMAIL' WHEN 4 THEN 'I-EMAIL' ELSE 'O' END), ' ') AS tags FROM i")
def _(spark, d):
    """Tags as ids (9 for an unknown tag) and back; an unknown id is ``O``."""
    ids = F.transform(bio.label_ids("tags"), lambda i: F.coalesce(i, F.lit(9)))
    rows = inputs.examples(spark, d).select("idx", ids.alias("ids"))
    return rows.select("idx", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), F.array_join(F.transform("ids", bio.tag_from_int), " ").alias("tags"))


_NAMES = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]


@query(
    "prj06_foreign_tags",
    f"""WITH {ex('test')}, f AS (SELECT idx, tokens, list_transform(tags, lambda t: CASE t WHEN 'O' THEN 0 WHEN 'B-PER' THEN 1 WHEN 'I-PER' THEN 2 WHEN 'B-EMAIL' THEN 3 WHEN 'I-EMAIL' THEN 5 ELSE 11 END) AS ids FROM ex WHERE len(tokens) > 0)
    SELECT idx, array_to_string(tokens, ' ') AS sequence, array_to_string(list_transform(ids, lambda i: CASE i WHEN 1 THEN 'B-PER' WHEN 2 THEN 'I-PER' ELSE 'O' END), ' ') AS tags FROM f""",
)
def _(spark, d):
    """A foreign label list keeps persons only; empty rows drop out; the text is rebuilt."""
    code = F.create_map(*[x for k, v in {"O": 0, "B-PER": 1, "I-PER": 2, "B-EMAIL": 3, "I-EMAIL": 5}.items() for x in (F.lit(k), F.lit(v))])
    rows = inputs.examples(spark, d, "test").where(F.size("tokens") > 0).withColumn("ids", F.transform("tags", lambda t: F.coalesce(F.try_element_at(code, t), F.lit(11))))
    return rows.select("idx", F.array_join("tokens", " ").alias("sequence"), F.array_join(bio.people_only("ids", F.array(*map(F.lit, _NAMES))), " ").alias("tags"))


@query("src09_min_entities", f"WITH {ex('test')} SELECT idx, len(list_filter(tags, lambda t: t = 'B-PER')) AS n_per FROM ex WHERE len(tokens) > 0 AND len(list_filter(tags, lambda t: t = 'B-PER')) >= 1")
def _(spark, d):
    n = bio.count_spans("tags", "PER").cast("long")
    return inputs.examples(spark, d, "test").where((F.size("tokens") > 0) & (n >= 1)).select("idx", n.alias("n_per"))


@query("prj07_padding", f"WITH {PRED} SELECT model, idx, array_to_string(pred, ' ') AS pred, len(coalesce(raw_pred, [])) AS raw_len FROM pred")
def _(spark, d):
    return inputs.predictions(spark, d).select("model", "idx", F.array_join("pred", " ").alias("pred"), F.size(bio.present("raw_pred")).cast("long").alias("raw_len"))


@query(
    "prj08_canonical",
    f"""WITH {PRED} SELECT model, count(*) AS n_rows, CAST(sum(len(gold)) AS BIGINT) AS gold_tags, CAST(sum(len(coalesce(raw_pred, []))) AS BIGINT) AS pred_tags FROM pred GROUP BY model""",
)
def _(spark, d):
    return inputs.predictions(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("gold")).alias("gold_tags"), F.sum(F.size(bio.present("raw_pred"))).alias("pred_tags"))


@query(
    "prj09_rebuilt",
    f"""WITH {ALL_EX} SELECT split, idx, array_to_string(tokens, ' ') AS sequence, sequence IS NULL AS was_null FROM ex WHERE sequence IS NULL OR sequence = ''""",
)
def _(spark, d):
    from tagloom.operators.masking import with_sequence

    e = inputs.all_examples(spark, d).withColumn("was_null", F.col("sequence").isNull())
    return with_sequence(e, True).where("rebuilt").select("split", "idx", "sequence", "was_null")


@query("prj10_11_span_text", f"""WITH {ex('test')}, {spans_of('sp', 'ex', 'idx', 'tags')} SELECT sp.idx, s, e, label, array_to_string(tokens[s + 1:e], ' ') AS text, tokens[s + 1] AS first_word, tokens[e] AS last_word FROM sp JOIN ex USING (idx)""")
def _(spark, d):
    rows = inputs.examples(spark, d, "test").select("idx", "tokens", F.explode(bio.spans("tags")).alias("x"))
    first, last = bio.span_name("tokens", F.col("x"))
    return rows.select("idx", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"), "x.label", bio.span_text("tokens", F.col("x")).alias("text"), first.alias("first_word"), last.alias("last_word"))


@query("prj12_ascii", f"WITH {ex('test')} SELECT idx, regexp_replace(sequence, '[^\\x00-\\x7F]', '?', 'g') AS shown FROM ex WHERE sequence IS NOT NULL")
def _(spark, d):
    return inputs.examples(spark, d, "test").where("sequence is not null").select("idx", bio.ascii_safe("sequence").alias("shown"))


@query("met13_tag_distribution", f"WITH {ALL_EX} SELECT split, x.tag, count(*) AS n FROM ex, unnest(ex.tags) AS x(tag) GROUP BY split, x.tag")
def _(spark, d):
    return inputs.all_examples(spark, d).select("split", F.explode("tags").alias("tag")).groupBy("split", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "met14_lengths",
    f"""WITH {ALL_EX}, n AS (SELECT split, len(tokens) AS n FROM ex) SELECT split, min(n) AS min_len, max(n) AS max_len, round(avg(n), 2) AS mean_len,
    quantile_cont(n, 0.5) AS median_len, round(quantile_cont(n, 0.95), 6) AS p95_len FROM n GROUP BY split""",
)
def _(spark, d):
    r = validation.length_statistics(inputs.all_examples(spark, d).withColumn("n_tokens", F.size("tokens").cast("long")), ["split"])
    return r


@query(
    "met15_span_histogram",
    f"""WITH {ALL_EX}, c AS (SELECT split, len(list_filter(tags, lambda t: t = 'B-PER')) AS p, len(list_filter(tags, lambda t: t = 'B-EMAIL')) AS m FROM ex)
    SELECT split, count(*) FILTER (p = 0) AS zero_per, count(*) FILTER (p = 1) AS one_per, count(*) FILTER (p > 1) AS multi_per, CAST(sum(m) AS BIGINT) AS email_spans FROM c GROUP BY split""",
)
def _(spark, d):
    n = bio.count_spans("tags", "PER")
    return inputs.all_examples(spark, d).groupBy("split").agg(
        F.count_if(n == 0).alias("zero_per"), F.count_if(n == 1).alias("one_per"), F.count_if(n > 1).alias("multi_per"), F.sum(bio.count_spans("tags", "EMAIL")).alias("email_spans")
    )


@query("met16_coverage", f"WITH {ALL_EX} SELECT split, round(100.0 * count(*) FILTER (len(tokens) <= 256) / count(*), 6) AS coverage_pct FROM ex GROUP BY split")
def _(spark, d):
    return inputs.all_examples(spark, d).groupBy("split").agg(F.round(100.0 * F.count_if(F.size("tokens") <= 256) / F.count(F.lit(1)), 6).alias("coverage_pct"))


@query("met18_split_buckets", f"WITH {ALL_EX}, c AS (SELECT split, len(list_filter(tags, lambda t: t = 'B-PER')) AS p FROM ex) SELECT split, CASE p WHEN 0 THEN 'zero_per' WHEN 1 THEN 'one_per' ELSE 'multi_per' END AS bucket, count(*) AS n FROM c GROUP BY ALL")
def _(spark, d):
    return inputs.all_examples(spark, d).groupBy("split", bio.density_bucket(bio.count_spans("tags", "PER")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("lim01_srt01_head", f"WITH {ex('test')} SELECT idx, len(tokens) AS n_tokens FROM ex ORDER BY idx LIMIT 50")
def _(spark, d):
    return inputs.examples(spark, d, "test").select("idx", F.size("tokens").cast("long").alias("n_tokens")).orderBy("idx").limit(50)


@query(
    "snk07_length_bins",
    f"""WITH {ALL_EX}, n AS (SELECT split, len(tokens) AS n FROM ex), b AS (SELECT split, min(n) AS lo, max(n) AS hi FROM n GROUP BY split)
    SELECT n.split, CAST(CASE WHEN hi = lo THEN 0 ELSE least(39, floor((n - lo) * 40 / (hi - lo)::DOUBLE)) END AS INT) AS bin, count(*) AS n FROM n JOIN b USING (split) GROUP BY ALL""",
)
def _(spark, d):
    rows = inputs.all_examples(spark, d).select("split", F.size("tokens").alias("n"))
    ends = rows.groupBy("split").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    width = (F.col("hi") - F.col("lo")).cast("double")
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(39), F.floor(F.try_divide((F.col("n") - F.col("lo")) * 40, width)))).cast("int")
    return rows.join(F.broadcast(ends), "split").groupBy("split", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # three splits


@query(
    "snk01_clean_rows",
    f"""WITH {ex()}, {STATUS} SELECT st.idx, st.lang, len(st.tokens) AS n_tokens, len(list_filter(tags, lambda t: t = 'B-PER')) AS raw_per, len(string_split(fx.fixed, 'B-PER')) - 1 AS n_per_spans FROM st JOIN fx USING (idx) WHERE st.status = 'valid'""",
)
def _(spark, d):
    rows = validation.status(inputs.examples(spark, d)).where("status = 'valid'")
    return rows.select("idx", "lang", F.size("tokens").cast("long").alias("n_tokens"), bio.count_spans("tags", "PER").cast("long").alias("raw_per"), bio.count_spans("fixed_tags", "PER").cast("long").alias("n_per_spans"))
