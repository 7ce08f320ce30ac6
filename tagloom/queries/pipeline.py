"""Queries INJ-*, SPL/SMP-*, TOK/ENC-* and LLM-*."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from tagloom.functions import bio
from tagloom.operators import alignment, bootstrap, injection, inputs, responses, splits
from tagloom.plans.staging import stage, staged_dir, table
from tagloom.queries.sql import ALL_EX, ex, ratio, spans_of
from tagloom.streaming import answers

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def u(salt: int, x: str = "idx") -> str:
    return bootstrap.PORTABLE_SQL.format(x=x, salt=salt)


# ---------------------------------------------------------------- injection

_T = injection.threshold


def _chosen_sql(split: str, config: dict) -> tuple[str, str]:
    """The candidates, and with them the chosen rows."""
    cand = f"WITH {ex(split)}, cand AS (SELECT * FROM ex WHERE list_contains(tags, 'B-PER') AND len(tokens) = len(tags))"
    order = f"SELECT *, row_number() OVER (ORDER BY {u(config['salt'] + injection.CHOOSE)}, idx) AS r, count(*) OVER () AS n FROM cand"
    return cand, f"{cand}, ch AS (SELECT * FROM ({order}) WHERE r <= CAST(floor(n * {config['injection_rate']}) AS BIGINT))"


def _weighted_sql(salt: int, options) -> str:
    """A CASE over cumulative weights."""
    out, total = "", 0.0
    for name, weight, *_ in options[:-1]:
        total += weight
        out += f" WHEN {u(salt)} < {_T(total)} THEN '{name}'"
    return f"CASE{out} ELSE '{options[-1][0]}' END" if out else f"'{options[-1][0]}'"


def _local_sql(template: str, salt: int) -> str:
    """A template of the local part as a SQL concatenation."""
    values = {"first": "first", "last": "last", "f": "f", "l": "l", "year": f"CAST(1970 + {u(salt + injection.YEAR)} % 36 AS VARCHAR)", "n": f"CAST(1 + {u(salt + injection.NUMBER)} % 99 AS VARCHAR)"}
    return " || ".join(values[x[1:-1]] if x.startswith("{") else f"'{x}'" for x in re.findall(r"\{\w+\}|[^{}]+", template))


def _injection_sql(split: str, config: dict) -> tuple[str, str, str, str]:
    """SQL up to the candidates, the chosen rows, their addresses and the injected rows."""
    cand, chosen = _chosen_sql(split, config)
    salt, i = config["salt"], injection
    span = f"{u(salt + i.SPAN, 'ch.idx')} % len(ss) + 1"
    domain = lambda key: f"{config[key]}[{u(salt + i.DOMAIN)} % {len(config[key])} + 1]"
    local = " ".join(f"WHEN '{name}' THEN {_local_sql(form, salt)}" for name, _, form in config["role_patterns"] + config["patterns"])
    mail = f"""{chosen}, {spans_of('sp', 'ch', 'idx', 'tags')},
  per AS (SELECT idx, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM sp WHERE label = 'PER' GROUP BY idx),
  pk AS (SELECT ch.idx, tokens, tags, ss[{span}] AS s, es[{span}] AS e FROM ch JOIN per USING (idx)),
  nm AS (SELECT *, lower(tokens[s + 1]) AS first, lower(tokens[e]) AS last FROM pk),
  pt AS (SELECT *, CASE WHEN {u(salt + i.ROLE)} < {_T(config['role_pattern_fraction'])} THEN {_weighted_sql(salt + i.ROLE_KIND, config['role_patterns'])} ELSE {_weighted_sql(salt + i.PATTERN, config['patterns'])} END AS pattern,
    CASE WHEN first = '' THEN 'x' ELSE substr(first, 1, 1) END AS f, CASE WHEN last = '' THEN 'x' ELSE substr(last, 1, 1) END AS l FROM nm),
  lc AS (SELECT *, CASE pattern {local} END || '@' || CASE WHEN {u(salt + i.PERSONAL)} < {_T(config['personal_share'])} THEN {domain('personal_domains')} ELSE {domain('corporate_domains')} END AS raw FROM pt),
  em AS (SELECT * EXCLUDE raw, CASE WHEN regexp_matches(raw, '^[a-z0-9._+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}$') THEN raw ELSE f || CASE WHEN last = '' THEN 'user' ELSE last END || '@{config['personal_domains'][0]}' END AS email,
    {u(salt + i.MULTI)} < {_T(config['multi_token_ratio'])} AS multi_token, {_weighted_sql(salt + i.CONTEXT, config['contexts'])} AS context FROM lc)"""
    put = f"""{mail}, w AS (SELECT *, CASE WHEN multi_token THEN [split_part(email, '@', 1), '@', substr(email, strpos(email, '@') + 1)] ELSE [email] END AS w,
    CASE WHEN multi_token THEN ['B-EMAIL', 'I-EMAIL', 'I-EMAIL'] ELSE ['B-EMAIL'] END AS m, len(tokens) AS n FROM em),
  p AS (SELECT *, CASE WHEN context <> 'contact_tail' THEN e WHEN tokens[n] IN ('.', '!', '?', ';') AND tags[n] NOT LIKE 'I-%' THEN n - 1 ELSE n END AS place,
    CASE WHEN context = 'parenthetical' THEN ['('] WHEN context = 'contact_tail' THEN ['Email:'] WHEN e < n AND tokens[e + 1] NOT IN ('.', '!', '?', ';') THEN [','] ELSE [] END AS b,
    CASE WHEN context = 'parenthetical' THEN [')'] ELSE [] END AS a FROM w),
  ins AS (SELECT *, list_concat(list_concat(list_concat(list_concat(tokens[1:place], b), w), a), tokens[place + 1:n]) AS new_tokens,
    list_concat(list_concat(list_concat(list_concat(tags[1:place], list_transform(b, lambda x: 'O')), m), list_transform(a, lambda x: 'O')), tags[place + 1:n]) AS new_tags, place + len(b) AS inserted_at FROM p)"""
    return cand, chosen, mail, put


_CAND, _CHOSEN, _MAIL, _PUT = _injection_sql("train", injection.CONFIG)
_, _, _MAIL_TEST, _PUT_TEST = _injection_sql("test", injection.TEST_CONFIG)


@query("inj01_candidates", f"{_CAND} SELECT count(*) AS candidates, min(idx) AS first_idx, max(idx) AS last_idx FROM cand")
def _(spark, d):
    return injection.candidates(inputs.examples(spark, d)).agg(F.count(F.lit(1)).alias("candidates"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("inj02_03_chosen", f"{_CHOSEN} SELECT idx FROM ch")
def _(spark, d):
    return injection.chosen(inputs.examples(spark, d), 0.6).select("idx")


def _emails(spark, d, split: str, config: dict):
    rows = injection.with_email(injection.chosen(inputs.examples(spark, d, split), config["injection_rate"], config["salt"]), config)
    return rows.select("idx", F.col("span.s").cast("long").alias("span_start"), F.col("span.e").cast("long").alias("span_end"), "first", "last", "pattern", "email")


_EMAIL_COLUMNS = "idx, s AS span_start, e AS span_end, first, last, pattern, email"


@query("inj04_07_emails", f"{_MAIL} SELECT {_EMAIL_COLUMNS} FROM em")
def _(spark, d):
    return _emails(spark, d, "train", injection.CONFIG)


@query("inj04_07_emails_test", f"{_MAIL_TEST} SELECT {_EMAIL_COLUMNS} FROM em")
def _(spark, d):
    """The test split has its own domains, patterns and role names; pools shared with train are an error."""
    injection.require_disjoint()
    return _emails(spark, d, "test", injection.TEST_CONFIG)


@query("inj08_email_tokens", f"{_PUT} SELECT idx, array_to_string(w, ' ') AS words, array_to_string(m, ' ') AS marks, multi_token FROM p")
def _(spark, d):
    rows = injection.with_email(injection.chosen(inputs.examples(spark, d), 0.6))
    w, m = injection.email_tokens(F.col("email"), F.col("multi_token"))
    return rows.select("idx", F.array_join(w, " ").alias("words"), F.array_join(m, " ").alias("marks"), "multi_token")


def _injected(spark, d, split: str, config: dict):
    rows = injection.injected(inputs.examples(spark, d, split), config)
    return rows.select("idx", "sequence", F.array_join("new_tags", " ").alias("tags"), "email", "context", "multi_token", F.col("inserted_at").cast("long").alias("inserted_at"))


_INJECTED_COLUMNS = "idx, array_to_string(new_tokens, ' ') AS sequence, array_to_string(new_tags, ' ') AS tags, email, context, multi_token, inserted_at"


@query("inj09_13_injected", f"{_PUT} SELECT {_INJECTED_COLUMNS} FROM ins")
def _(spark, d):
    return _injected(spark, d, "train", injection.CONFIG)


@query("inj09_13_injected_test", f"{_PUT_TEST} SELECT {_INJECTED_COLUMNS} FROM ins")
def _(spark, d):
    return _injected(spark, d, "test", injection.TEST_CONFIG)


@query("inj14_choices", f"{_MAIL} SELECT context, multi_token, count(*) AS n FROM em GROUP BY ALL")
def _(spark, d):
    rows = injection.with_email(injection.chosen(inputs.examples(spark, d), 0.6))
    return rows.groupBy("context", "multi_token").agg(F.count(F.lit(1)).alias("n"))


@query("inj16_distributions", f"{_MAIL} SELECT 'context' AS kind, context AS value, count(*) AS n FROM em GROUP BY ALL UNION ALL SELECT 'domain', split_part(email, '@', -1), count(*) FROM em GROUP BY ALL UNION ALL SELECT 'pattern', pattern, count(*) FROM em GROUP BY ALL UNION ALL SELECT 'multi_token', CAST(multi_token AS VARCHAR), count(*) FROM em GROUP BY ALL")
def _(spark, d):
    return injection.distributions(injection.with_email(injection.chosen(inputs.examples(spark, d), 0.6)))


@query("inj16_rate", f"{_CHOSEN}, c AS (SELECT count(*) AS candidates FROM cand), k AS (SELECT count(*) AS injected FROM ch) SELECT candidates, injected, {ratio('injected', 'candidates')} AS rate FROM c, k")
def _(spark, d):
    e = inputs.examples(spark, d)
    c = injection.candidates(e).agg(F.count(F.lit(1)).alias("candidates")).withColumn("_one", F.lit(1))
    k = injection.chosen(e, 0.6).agg(F.count(F.lit(1)).alias("injected")).withColumn("_one", F.lit(1))
    return c.join(k, "_one").drop("_one").withColumn("rate", bio.ratio(F.col("injected"), F.col("candidates")))


@query("snk02_injected_columns", f"{_PUT} SELECT ex.idx, ins.email AS injected_email_str, ins.context AS injected_email_context, ins.multi_token AS injected_email_multi_token, CAST(ins.inserted_at AS INT) AS injected_email_inserted_at FROM ex LEFT JOIN ins USING (idx)")
def _(spark, d):
    """The injected table: all rows, the four columns null where nothing was written; through Parquet and back."""
    e = inputs.examples(spark, d)
    i = injection.injected(e).select("idx", F.col("email").alias("injected_email_str"), F.col("context").alias("injected_email_context"), F.col("multi_token").alias("injected_email_multi_token"), F.col("inserted_at").cast("int").alias("injected_email_inserted_at"))
    return stage(e.select("idx").join(i, "idx", "left"), "injected")


@query("inj15_permutation", f"WITH {ex('test')} SELECT idx, row_number() OVER (ORDER BY {u(12)}, idx) - 1 AS position FROM ex")
def _(spark, d):
    return splits.permuted(inputs.examples(spark, d, "test").select("idx"), injection.SHUFFLE)


@query(
    "inj17_resplit",
    f"""WITH ex AS (SELECT DISTINCT idx, 'train' AS split FROM train_injected WHERE idx IS NOT NULL UNION ALL SELECT DISTINCT idx, 'val' FROM val_injected WHERE idx IS NOT NULL),
    n AS (SELECT count(*) AS n, count(*) FILTER (split = 'train') AS nt FROM ex), o AS (SELECT idx, split AS old_split, row_number() OVER (ORDER BY {u(12)}, idx) - 1 AS k FROM ex)
    SELECT old_split, CASE WHEN k < round_even(n * (nt / CAST(n AS DOUBLE)), 0) THEN 'train' ELSE 'val' END AS new_split, count(*) AS n_rows FROM o, n GROUP BY ALL""",
)
def _(spark, d):
    """Union of train and val, shuffled and cut again by position; the old split stays in a column."""
    both = inputs.all_examples(spark, d).where("split <> 'test'").select("idx", "split")
    order = splits.permuted(both, injection.SHUFFLE)
    n = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("nt")).withColumn("_one", F.lit(1))
    cut = F.bround(F.col("n") * (F.col("nt") / F.col("n")), 0)
    rows = order.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one")  # one row
    return rows.groupBy(F.col("split").alias("old_split"), F.when(F.col("position") < cut, "train").otherwise("val").alias("new_split")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("inj18_samples", f"{_PUT} SELECT rpad(context, 15, ' ') || ' ' || rpad(email, 40, ' ') AS line FROM ins ORDER BY {u(77)}, idx LIMIT 5")
def _(spark, d):
    rows = splits.drawn(injection.injected(inputs.examples(spark, d)), 5, 77)
    return rows.select(F.concat(F.rpad("context", 15, " "), F.lit(" "), F.rpad("email", 40, " ")).alias("line"))


# ---------------------------------------------------------------- splits and samples

_BUCKET = "CASE len(list_filter(tags, lambda t: t = 'B-PER')) WHEN 0 THEN 'zero_per' WHEN 1 THEN 'one_per' ELSE 'multi_per' END"


@query(
    "spl01_stratified",
    f"""WITH {ex()}, b AS (SELECT idx, {_BUCKET} AS bucket FROM ex), s AS (SELECT bucket, count(*) AS n, floor(count(*) * 0.15) AS low, round(count(*) * 0.15 - floor(count(*) * 0.15), 9) AS rest FROM b GROUP BY bucket),
    q AS (SELECT bucket, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, bucket) <= ceil(round(sum(n) OVER () * 0.15, 9)) - sum(low) OVER () THEN 1 ELSE 0 END AS quota FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {u(42)}, idx) AS r FROM b)
    SELECT idx, bucket, CASE WHEN r <= quota THEN 'val' ELSE 'train' END AS split FROM r JOIN q USING (bucket)""",
)
def _(spark, d):
    rows = inputs.examples(spark, d).select("idx", bio.density_bucket(bio.count_spans("tags", "PER")).alias("bucket"))
    return splits.stratified(rows, "bucket", 0.15).select("idx", "bucket", "split")


@query(
    "smp02_subset",
    " UNION ALL ".join(f"(SELECT '{s}' AS split, idx FROM (SELECT DISTINCT idx FROM {s}_injected WHERE idx IS NOT NULL) ORDER BY {u(42)}, idx LIMIT {n})" for s, n in (("train", 2500), ("val", 500)))
    + " UNION ALL (SELECT 'test' AS split, idx FROM (SELECT DISTINCT idx FROM test_injected WHERE idx IS NOT NULL) ORDER BY idx LIMIT 500)",
)
def _(spark, d):
    """The smoke test's rows: 2,500 drawn of train, 500 drawn of val, the first 500 of test."""
    of = lambda s: inputs.examples(spark, d, s).select(F.lit(s).alias("split"), "idx")
    parts = splits.drawn(of("train"), 2500, 42).unionByName(splits.drawn(of("val"), 500, 42)).unionByName(of("test").orderBy("idx").limit(500))
    return parts.orderBy("split", "idx")


# ---------------------------------------------------------------- subwords

_PIECES = f"""WITH {ex('test')}, pc AS (SELECT ex.idx, t.pos - 1 AS w, g.k, ex.tags[t.pos] AS tag FROM ex, unnest(ex.tokens) WITH ORDINALITY AS t(tok, pos), range(greatest(CAST(ceil(length(t.tok) / 4.0) AS BIGINT), 1)) g(k)),
  pl AS (SELECT *, CASE WHEN k > 0 AND tag LIKE 'B-%' THEN 'I-' || substr(tag, 3) ELSE tag END AS lab, row_number() OVER (PARTITION BY idx ORDER BY w, k) AS p FROM pc),
  pi AS (SELECT *, CASE lab WHEN 'B-PER' THEN 1 WHEN 'I-PER' THEN 2 WHEN 'B-EMAIL' THEN 3 WHEN 'I-EMAIL' THEN 4 ELSE 0 END AS y FROM pl)"""


def _labels(spark, d):
    e = inputs.examples(spark, d, "test").withColumn("word_ids", alignment.chunk_word_ids("tokens"))
    return e.withColumn("labels", alignment.aligned_labels("word_ids", "tags"))


@query("tok01_labels", f"{_PIECES} SELECT idx, '-100 ' || string_agg(CAST(y AS VARCHAR), ' ' ORDER BY p) || ' -100' AS labels FROM pi GROUP BY idx")
def _(spark, d):
    rows = _labels(spark, d).where(F.size("tokens") > 0)
    return rows.select("idx", F.array_join(F.transform("labels", lambda v: v.cast("string")), " ").alias("labels"))


@query("tok01_subwords")
def _(spark, d):
    """Labels over the subwords of a public tokenizer instead of the built-in chunks; null without its file."""
    e = inputs.examples(spark, d, "test").where(F.size("tokens") > 0).select("idx", "tokens", "tags")
    ids = alignment.tokenizer_word_ids(spark)
    rows = e.withColumn("word_ids", ids("tokens") if ids else F.lit(None).cast("array<int>"))
    return rows.select("idx", F.array_join(F.transform(alignment.aligned_labels("word_ids", "tags"), lambda v: v.cast("string")), " ").alias("labels"))


@query("tok02_fitted", f"{_PIECES}, n AS (SELECT idx, count(*) + 2 AS n, count(*) FILTER (p <= 255 AND y IN (1, 3)) AS starts FROM pi GROUP BY idx) SELECT idx, CAST(256 AS BIGINT) AS size, starts FROM n")
def _(spark, d):
    rows = _labels(spark, d).where(F.size("tokens") > 0).withColumn("y", alignment.fitted("labels"))
    return rows.select("idx", F.size("y").cast("long").alias("size"), F.size(F.filter("y", lambda v: v.isin(1, 3))).cast("long").alias("starts"))


_FIRST, _LATER = (f"CASE {c} WHEN 'B-PER' THEN 1 WHEN 'I-PER' THEN 2 WHEN 'B-EMAIL' THEN 3 WHEN 'I-EMAIL' THEN 4 ELSE 0 END" for c in ("tag", "'I-' || substr(tag, 3)"))


@query(
    "tok03_rows",
    f"""WITH {ALL_EX}, pc AS (SELECT ex.split, ex.idx, t.pos AS w, g.k, ex.tags[t.pos] AS tag FROM ex, unnest(ex.tokens) WITH ORDINALITY AS t(tok, pos), range(greatest(CAST(ceil(length(t.tok) / 4.0) AS BIGINT), 1)) g(k)),
    y AS (SELECT split, idx, list(CASE WHEN k > 0 AND tag LIKE 'B-%' THEN {_LATER} ELSE {_FIRST} END ORDER BY w, k) AS ys FROM pc GROUP BY ALL)
    SELECT ex.split, ex.idx, array_to_string(list_slice(list_concat(list_concat([-100], coalesce(y.ys, [])), list_transform(range(257), lambda x: -100)), 1, 256), ' ') AS labels FROM ex LEFT JOIN y USING (split, idx)""",
)
def _(spark, d):
    """Every split aligned and fitted, without the columns a trainer does not need."""
    e = inputs.all_examples(spark, d).withColumn("word_ids", alignment.chunk_word_ids("tokens"))
    return e.select("split", "idx", F.array_join(F.transform(alignment.fitted(alignment.aligned_labels("word_ids", "tags")), lambda v: v.cast("string")), " ").alias("labels"))


@query(
    "tok04_statistics",
    f"""{_PIECES}, h AS (SELECT idx FROM ex WHERE len(tokens) > 0 ORDER BY idx LIMIT 500), n AS (SELECT idx, count(*) + 2 AS n FROM pi SEMI JOIN h USING (idx) GROUP BY idx)
    SELECT round((SELECT avg(n) FROM n), 4) AS mean_len, round(100.0 * count(*) FILTER (y IN (1, 2)) / count(*), 4) AS per_pct, round(100.0 * count(*) FILTER (y IN (3, 4)) / count(*), 4) AS email_pct FROM pi SEMI JOIN h USING (idx)""",
)
def _(spark, d):
    head = _labels(spark, d).where(F.size("tokens") > 0).orderBy("idx").limit(500).withColumn("y", F.filter("labels", lambda v: v != bio.IGNORED))
    of = lambda *ids: F.round(100.0 * F.sum(F.size(F.filter("y", lambda v: v.isin(*ids)))) / F.sum(F.size("y")), 4)
    return head.agg(F.round(F.avg(F.size("labels")), 4).alias("mean_len"), of(1, 2).alias("per_pct"), of(3, 4).alias("email_pct"))


@query("tok05_truncated", f"{_PIECES} SELECT idx, least(count(*) + 2, 64) AS n, count(*) FILTER (p <= 63 AND y = 1) AS b_per FROM pi GROUP BY idx")
def _(spark, d):
    rows = _labels(spark, d).where(F.size("tokens") > 0).withColumn("y", F.slice("labels", 1, 64))
    return rows.select("idx", F.size("y").cast("long").alias("n"), F.size(F.filter("y", lambda v: v == 1)).cast("long").alias("b_per"))


@query("val10_label_faults", f"{_PIECES}, f AS (SELECT idx, arg_min(y, p) AS y FROM pi GROUP BY idx) SELECT idx, CASE WHEN y IN (2, 4) THEN 'starts inside' END AS fault FROM f")
def _(spark, d):
    return _labels(spark, d).where(F.size("tokens") > 0).select("idx", alignment.label_faults("labels").alias("fault"))


@query("enc01_word_tags", f"{_PIECES} SELECT idx, string_agg(CASE WHEN p <= {alignment.MAX_PIECES - 2} THEN CASE WHEN y = 0 THEN 'O' ELSE lab END ELSE 'O' END, ' ' ORDER BY w) AS tags FROM pi WHERE k = 0 GROUP BY idx")
def _(spark, d):
    """Labels of ``MAX_PIECES`` pieces, both special ones among them, back to words: the first piece wins, cut words are ``O``."""
    cut = lambda c: F.slice(c, 1, alignment.MAX_PIECES - 1)  # noqa: E731  # the last place is the closing special piece's
    rows = _labels(spark, d).where(F.size("tokens") > 0).select("idx", "tokens", cut("word_ids").alias("w"), cut("labels").alias("y"))
    return rows.select("idx", F.array_join(alignment.word_tags("w", "y", "tokens"), " ").alias("tags"))


@query("enc02_missing_models", "WITH m AS (SELECT unnest(['encoder_a', 'encoder_b', 'encoder_c', 'llm']) AS model) SELECT model FROM m WHERE model NOT IN (SELECT model FROM encoder_predictions) AND model <> 'llm'")
def _(spark, d):
    """The configured models that have no predictions yet."""
    wanted = spark.createDataFrame([("encoder_a",), ("encoder_b",), ("encoder_c",), ("llm",)], "model string")
    done = inputs.predictions(spark, d).select("model").distinct()
    return wanted.join(done, "model", "left_anti")


@query("enc03_argmax", f"{_PIECES} SELECT y AS label, count(*) AS n, count(*) FILTER (CASE WHEN (idx + p) % 7 = 0 THEN 0 ELSE y END = y) AS hits FROM pi GROUP BY y")
def _(spark, d):
    """Scores of five classes (off on every seventh piece), argmax, ignored pieces dropped."""
    rows = _labels(spark, d).where(F.size("tokens") > 0).select("idx", F.posexplode("labels").alias("p", "y")).where(F.col("y") != bio.IGNORED)
    best = F.when((F.col("idx") + F.col("p")) % 7 == 0, 0).otherwise(F.col("y"))
    scores = F.transform(F.array(*[F.lit(k) for k in range(5)]), lambda k: F.when(k == best, 0.9).otherwise(0.1))
    return rows.withColumn("hit", alignment.argmax(scores) == F.col("y")).groupBy(F.col("y").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


# ---------------------------------------------------------------- language model

_LLM = "l AS (SELECT DISTINCT ON (idx) * FROM llm_predictions WHERE idx IS NOT NULL ORDER BY idx)"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CLEAN = f"""{_LLM}, c1 AS (SELECT idx, sequence, raw_response, trim(coalesce(raw_response, ''), {_WS}) AS a FROM l),
  c2 AS (SELECT *, CASE WHEN starts_with(a, 'assistant') THEN trim(substr(a, 10), {_WS}) ELSE a END AS b FROM c1),
  c3 AS (SELECT *, CASE WHEN regexp_matches(b, '(?s)```json\\s*(.*?)```') THEN trim(regexp_extract(b, '(?s)```json\\s*(.*?)```', 1), {_WS})
    WHEN regexp_matches(b, '(?s)```\\s*(.*?)```') THEN trim(regexp_extract(b, '(?s)```\\s*(.*?)```', 1), {_WS}) ELSE b END AS t FROM c2)"""
_PARSE = (
    _CLEAN
    + """, p1 AS (SELECT *, regexp_extract(t, '(?s)(\\{.*\\})', 1) AS w FROM c3),
  p2 AS (SELECT *, CASE WHEN t <> '' AND json_valid(t) THEN 1 WHEN w <> '' AND json_valid(w) THEN 2 WHEN contains(t, '{') THEN 3 ELSE 0 END AS stage FROM p1),
  p3 AS (SELECT *, CASE stage WHEN 1 THEN t WHEN 2 THEN w END AS j, regexp_extract(t, '(?s)(\\{.*)', 1) AS fr FROM p2),
  p4 AS (SELECT *, json_type(j) = 'OBJECT' AS obj FROM p3),
  p5 AS (SELECT *, """
    + ", ".join(
        f"""CASE WHEN stage = 3 THEN regexp_extract_all(regexp_extract(fr, '"{k}"\\s*:\\s*\\[([^\\]]*)', 1), '"([^"]+)"', 1)
      WHEN obj AND json_exists(j, '$.{k}') IS NOT TRUE THEN [] WHEN obj AND json_type(j, '$.{k}') = 'ARRAY'
      THEN list_transform(list_filter(json_extract(j, '$.{k}[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$') END AS {k}_"""
        for k in ("names", "emails")
    )
    + f""" FROM p4),
  pr AS (SELECT idx, sequence, raw_response, stage, names_ IS NOT NULL AND emails_ IS NOT NULL AND stage > 0 AS ok,
    CASE WHEN names_ IS NOT NULL AND emails_ IS NOT NULL THEN list_filter(names_, lambda x: trim(x, {_WS}) <> '') ELSE [] END AS names,
    CASE WHEN names_ IS NOT NULL AND emails_ IS NOT NULL THEN list_filter(emails_, lambda x: trim(x, {_WS}) <> '') ELSE [] END AS emails FROM p5),
  gr AS (SELECT idx, sequence, stage, ok, list_filter(names, lambda x: contains(lower(coalesce(sequence, '')), lower(trim(x, {_WS})))) AS names,
    list_filter(emails, lambda x: contains(lower(coalesce(sequence, '')), lower(trim(x, {_WS})))) AS emails FROM pr)"""
)


def _responses(spark, d):
    return inputs.llm_predictions(spark, d).select("idx", "sequence", "tokens", "raw_response")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query("llm01_prompts", f"WITH {ex('test')} SELECT idx, {_sql_text(responses.PROMPT_HEAD)} || sequence || {_sql_text(responses.PROMPT_TAIL)} AS prompt FROM ex WHERE sequence IS NOT NULL")
def _(spark, d):
    return inputs.examples(spark, d, "test").where("sequence is not null").select("idx", responses.prompt("sequence").alias("prompt"))


@query("llm02_cleaned", f"WITH {_CLEAN} SELECT idx, t AS cleaned FROM c3")
def _(spark, d):
    return _responses(spark, d).select("idx", F.coalesce(responses.cleaned("raw_response"), F.lit("")).alias("cleaned"))


@query("llm03_05_parsed", f"WITH {_PARSE} SELECT idx, stage, ok AS parse_ok, array_to_string(names, '|') AS names, array_to_string(emails, '|') AS emails FROM pr")
def _(spark, d):
    return responses.parsed(_responses(spark, d)).select("idx", "stage", "parse_ok", F.array_join("names", "|").alias("names"), F.array_join("emails", "|").alias("emails"))


@query("llm04_failure_log", f"WITH {_PARSE} SELECT idx, sequence, raw_response FROM pr WHERE NOT ok")
def _(spark, d):
    return responses.parsed(_responses(spark, d)).where("not parse_ok").select("idx", "sequence", "raw_response")


@query("llm06_07_grounded", f"WITH {_PARSE} SELECT idx, array_to_string(list_filter(names, lambda n: len(list_filter(emails, lambda e: contains(lower(trim(e, {_WS})), lower(trim(n, {_WS}))))) = 0), '|') AS names, array_to_string(emails, '|') AS emails FROM gr")
def _(spark, d):
    rows = responses.without_mail_names(responses.grounded(responses.parsed(_responses(spark, d))))
    return rows.select("idx", F.array_join("names", "|").alias("names"), F.array_join("emails", "|").alias("emails"))


_STRIP = "regexp_replace({x}, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')"
_WORDS = "list_transform(list_filter(regexp_split_to_array({x}, '\\s+'), lambda x: x <> ''), lambda x: " + _STRIP.format(x="x") + ")"


def _window(parts: str) -> str:
    """The first place where free words equal the parts, from 1."""
    return f"CASE WHEN len({parts}) > 0 THEN list_filter(range(1, len(bare) - len({parts}) + 2), lambda p: bare[p:p + len({parts}) - 1] = {parts} AND len(list_filter(tags[p:p + len({parts}) - 1], lambda t: t <> 'O')) = 0)[1] END"


_ALIGN = f"""{_PARSE}, nm AS (SELECT gr.idx, list_filter(gr.names, lambda n: len(list_filter(gr.emails, lambda e: contains(lower(trim(e, {_WS})), lower(trim(n, {_WS}))))) = 0) AS names, gr.emails, coalesce(l.tokens, []) AS tokens FROM gr JOIN l USING (idx)),
  en AS (SELECT idx, tokens, list_transform(tokens, lambda t: {_STRIP.format(x='lower(t)')}) AS bare,
    list_concat(list_transform(emails, lambda e: {{'text': lower(trim(e, {_WS})), 'kind': 'EMAIL'}}), list_transform(names, lambda e: {{'text': lower(trim(e, {_WS})), 'kind': 'PER'}})) AS es FROM nm),
  al AS (SELECT idx, 0 AS k, list_transform(tokens, lambda t: 'O') AS tags FROM en UNION ALL
    SELECT idx, k + 1, CASE WHEN at1 IS NULL THEN tags ELSE list_transform(tags, lambda t, i: CASE WHEN i = at1 THEN 'B-' || kind WHEN i > at1 AND i < at1 + n THEN 'I-' || kind ELSE t END) END FROM (
      SELECT *, coalesce(whole, mail, plain) AS at1, CASE WHEN whole IS NOT NULL THEN 1 WHEN mail IS NOT NULL THEN len(split) ELSE len(words) END AS n FROM (
        SELECT *, CASE WHEN contains(low, '@') THEN list_filter(range(1, len(bare) + 1), lambda i: bare[i] = {_STRIP.format(x='low')} AND tags[i] = 'O')[1] END AS whole,
          CASE WHEN contains(low, '@') AND len(split) >= 2 THEN {_window('split')} END AS mail, {_window('words')} AS plain FROM (
          SELECT al.idx, k, tags, en.bare, en.es[k + 1].text AS low, en.es[k + 1].kind AS kind, {_WORDS.format(x="replace(en.es[k + 1].text, '@', ' @ ')")} AS split, {_WORDS.format(x='en.es[k + 1].text')} AS words
          FROM al JOIN en USING (idx) WHERE k < len(en.es)))))"""


@query("llm08_09_aligned", f"WITH RECURSIVE {_ALIGN} SELECT idx, array_to_string(arg_max(tags, k), ' ') AS tags FROM al GROUP BY idx")
def _(spark, d):
    """Answers to tags, all steps."""
    rows = responses.without_mail_names(responses.grounded(responses.parsed(_responses(spark, d))))
    return rows.select("idx", F.array_join(responses.aligned("tokens", "names", "emails"), " ").alias("tags"))


@query("llm10_backend")
def _(spark, d):
    """The built-in rule backend over the records without an answer, parsed and aligned."""
    todo = responses.pending(inputs.examples(spark, d, "test").where("sequence is not null"), table(spark, d, "llm_predictions"))
    rows = responses.answered(todo.select("idx", "sequence", "tokens", responses.prompt("sequence").alias("prompt")), responses.rule_backend)
    rows = responses.without_mail_names(responses.grounded(responses.parsed(rows)))
    return rows.select("idx", "parse_ok", F.array_join(responses.aligned("tokens", "names", "emails"), " ").alias("tags"))


@query("llm11_pending", f"WITH {ex('test')} SELECT idx FROM ex WHERE idx NOT IN (SELECT idx FROM llm_predictions WHERE idx IS NOT NULL)")
def _(spark, d):
    return responses.pending(inputs.examples(spark, d, "test").select("idx"), table(spark, d, "llm_predictions"))


@query("llm11_resumed", f"WITH {ex('test')} SELECT idx, true AS parse_ok FROM ex WHERE sequence IS NOT NULL AND idx NOT IN (SELECT idx FROM llm_predictions WHERE idx IS NOT NULL)")
def _(spark, d):
    """The open records answered by the rule backend with a checkpoint every 50 records a file."""
    todo = responses.pending(inputs.examples(spark, d, "test").where("sequence is not null"), table(spark, d, "llm_predictions"))
    rows = todo.select("idx", "sequence", responses.prompt("sequence").alias("prompt"))
    done = answers.answer_resumably(rows, responses.rule_backend, f"{staged_dir(spark)}/answers-{uuid.uuid4().hex}")
    return responses.parsed(done).select("idx", "parse_ok")


@query("llm12_canonical", f"WITH {_LLM} SELECT idx, array_to_string(coalesce(predicted_tags, []), ' ') AS pred, array_to_string(coalesce(ner_tags, []), ' ') AS gold, coalesce(parse_ok, false) AS parse_ok FROM l ORDER BY idx")
def _(spark, d):
    rows = inputs.llm_predictions(spark, d)
    j = lambda c: F.array_join(bio.present(c), " ")
    return rows.select("idx", j("predicted_tags").alias("pred"), j("ner_tags").alias("gold"), F.coalesce("parse_ok", F.lit(False)).alias("parse_ok")).orderBy("idx")


@query("llm13_smoke_gate", f"WITH {_PARSE}, h AS (SELECT ok FROM pr ORDER BY idx LIMIT 3) SELECT count(*) AS asked, count(*) FILTER (ok) AS parsed, count(*) FILTER (ok) > 0 AS passes FROM h")
def _(spark, d):
    head = responses.parsed(_responses(spark, d).orderBy("idx").limit(3))
    return head.agg(F.count(F.lit(1)).alias("asked"), F.count_if("parse_ok").alias("parsed")).withColumn("passes", F.col("parsed") > 0)
