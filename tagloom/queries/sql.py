"""Common parts of the DuckDB texts."""

EX = """ex AS (SELECT DISTINCT ON (idx) idx, lang, sequence, coalesce(tokens, []) AS tokens, coalesce(ner_tags, []) AS tags
  FROM {table} WHERE idx IS NOT NULL ORDER BY idx)"""


def ex(split: str = "train") -> str:
    return EX.format(table=f"{split}_injected")


ALL_EX = """ex AS (SELECT DISTINCT ON (split, idx) split, idx, lang, sequence, coalesce(tokens, []) AS tokens, coalesce(ner_tags, []) AS tags FROM (
  SELECT 'train' AS split, idx, lang, sequence, tokens, ner_tags FROM train_injected UNION ALL
  SELECT 'val', idx, lang, sequence, tokens, ner_tags FROM val_injected UNION ALL
  SELECT 'test', idx, lang, sequence, tokens, ner_tags FROM test_injected) WHERE idx IS NOT NULL ORDER BY split, idx)"""

ENC = """enc AS (SELECT model, idx, tokens, sequence, gold_tags, pred_tags FROM encoder_predictions WHERE idx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY model, idx ORDER BY run_at DESC) = 1)"""

PRED = (
    ENC
    + """, pred AS (SELECT model, idx, coalesce(tokens, []) AS tokens, sequence, coalesce(gold_tags, []) AS gold, pred_tags AS raw_pred,
    list_slice(list_concat(coalesce(pred_tags, []), list_transform(range(len(coalesce(gold_tags, []))), lambda x: 'O')), 1, len(coalesce(gold_tags, []))) AS pred
  FROM (SELECT * FROM enc UNION ALL SELECT 'llm', idx, tokens, sequence, ner_tags, predicted_tags FROM (SELECT DISTINCT ON (idx) * FROM llm_predictions WHERE idx IS NOT NULL ORDER BY idx)))"""
)


def spans_of(name: str, source: str, keys: str, tags: str) -> str:
    """A span table (keys, s, e, label) by islands over the unnested tags."""
    k = ", ".join(f"t.{c.strip()}" for c in keys.split(","))
    return f"""{name} AS (SELECT {keys}, min(pos) AS s, max(pos) + 1 AS e, any_value(kind) AS label FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY pos) AS island FROM (
      SELECT *, CASE WHEN tag LIKE 'I-%' AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS fresh FROM (
        SELECT {k}, u.pos - 1 AS pos, u.tag, CASE WHEN u.tag <> 'O' THEN substr(u.tag, 3) ELSE '' END AS kind
        FROM {source} t, unnest(t.{tags}) WITH ORDINALITY AS u(tag, pos)) WINDOW w AS (PARTITION BY {keys} ORDER BY pos)))
    GROUP BY {keys}, island HAVING arg_min(tag, pos) LIKE 'B-%')"""


SPANS = PRED + ", " + spans_of("gs", "pred", "model, idx", "gold") + ", " + spans_of("ps", "pred", "model, idx", "pred")

#: One row for each span of either side: hit, only gold or only predicted.
MATCHED = (
    SPANS
    + """, m AS (SELECT coalesce(gs.model, ps.model) AS model, coalesce(gs.idx, ps.idx) AS idx, coalesce(gs.s, ps.s) AS s, coalesce(gs.e, ps.e) AS e,
    coalesce(gs.label, ps.label) AS label, gs.s IS NOT NULL AS in_gold, ps.s IS NOT NULL AS in_pred
  FROM gs FULL OUTER JOIN ps ON gs.model = ps.model AND gs.idx = ps.idx AND gs.s = ps.s AND gs.e = ps.e AND gs.label = ps.label)"""
)

SCORES = (
    MATCHED
    + """, sc AS (SELECT model, label, count(*) FILTER (in_gold AND in_pred) AS tp, count(*) FILTER (in_pred AND NOT in_gold) AS fp,
    count(*) FILTER (in_gold AND NOT in_pred) AS fn FROM m GROUP BY model, label)"""
)


#: Missed and invented spans, and their numbers by bucket.
ERR = (
    MATCHED
    + """, er AS (SELECT m.model, m.idx, CASE WHEN in_gold THEN 'FN_' ELSE 'FP_' END || CASE WHEN label = 'PER' THEN 'PER' ELSE 'EMAIL' END AS error_type, s, e,
    array_to_string(pred.tokens[s + 1:e], ' ') AS text, array_to_string(pred.tokens, ' ') AS tokens FROM m JOIN pred USING (model, idx) WHERE in_gold <> in_pred),
  bk AS (SELECT model, count(*) FILTER (error_type = 'FN_PER') AS fn_per, count(*) FILTER (error_type = 'FN_EMAIL') AS fn_email, count(*) FILTER (error_type = 'FP_PER') AS fp_per,
    count(*) FILTER (error_type = 'FP_EMAIL') AS fp_email, count(*) AS total_errors FROM er GROUP BY model)"""
)


def ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END, 6)"
