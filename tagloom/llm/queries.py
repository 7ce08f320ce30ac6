"""The registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import bpe, layout, lookalike, overlap, packing, redaction, sampling, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": overlap.p1_found,
    "p1_report": overlap.p1_report,
    "p2_found": layout.p2_found,
    "p2_copies": layout.p2_copies,
    "p2_steps": layout.p2_steps,
    "p3_found": redaction.p3_found,
    "p3_redacted": redaction.p3_redacted,
    "p4_found": lookalike.p4_found,
    "p4_tokens": lookalike.p4_tokens,
    "p5_found": sampling.p5_found,
    "p5_report": sampling.p5_report,
    "p5_sample": sampling.p5_sample,
    "p5_counts": sampling.p5_counts,
    "p6_ids": bpe.p6_ids,
    "p6_decoded": bpe.p6_decoded,
    "p6_ways": bpe.p6_ways,
    "p7_packed": packing.p7_packed,
    "p7_report": packing.p7_report,
    "p7_rules": packing.p7_rules,
    "p8_found": truncation.p8_found,
    "p8_report": truncation.p8_report,
}

_KEYED = r"""k AS (
  SELECT 'train_injected' AS table_name, idx AS id, sequence, tokens FROM train_injected UNION ALL
  SELECT 'raw_examples', raw_id, payload ->> '$.sequence', list_transform(json_extract(payload, '$.tokens[*]'), lambda x: x ->> '$')
  FROM (SELECT * FROM raw_examples WHERE json_valid(payload)) WHERE json_type(payload) = 'OBJECT'),
g AS (SELECT DISTINCT table_name, id, regexp_replace(lower(sequence), '[^\p{L}\p{N}]+', '', 'g') AS ks,
  regexp_replace(lower(coalesce(array_to_string(tokens, ''), '')), '[^\p{L}\p{N}]+', '', 'g') AS kt FROM k WHERE sequence <> '' AND id IS NOT NULL)"""

_WANTS = """c AS (SELECT DISTINCT ON (idx) idx, lower(regexp_replace(entity_density_bucket, '^\\s+|\\s+$', '', 'g')) AS b, least(n_email_spans, 2) AS m FROM train_injected WHERE idx IS NOT NULL ORDER BY idx),
n AS (SELECT count(*) AS n FROM c), a AS (SELECT b, m, count(*) AS available FROM c WHERE b IS NOT NULL AND m IS NOT NULL GROUP BY b, m),
w AS (SELECT t.target_set, t.entity_density_bucket, t.n_email_spans, coalesce(a.available, 0) AS available, CAST(floor(n * sample_per_mille / 1000.0) AS BIGINT) AS s, t.min_rows, t.target_per_mille
  FROM sample_targets t CROSS JOIN n LEFT JOIN a ON a.b = t.entity_density_bucket AND a.m = t.n_email_spans),
q AS (SELECT *, greatest(min_rows, CAST(floor(s * target_per_mille / 1000.0) AS BIGINT)) AS wanted FROM w)"""



def _passed(source: str, name: str, group: str, given: str) -> str:
    """SQL of one level of the tree: unmet quota goes to the leaves of ``group`` with spare rows, largest spare first."""
    leaf = "entity_density_bucket, n_email_spans"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""{name}_m AS (SELECT *, least(sum(unmet) OVER (PARTITION BY {group}), sum(spare) OVER (PARTITION BY {group})) AS moved,
    coalesce(sum(spare) OVER (PARTITION BY {group} ORDER BY spare DESC, {leaf} {before}), 0) AS spare_before,
    coalesce(sum(unmet) OVER (PARTITION BY {group} ORDER BY {leaf} {before}), 0) AS unmet_before FROM {source}),
{name} AS (SELECT * EXCLUDE (moved, spare_before, unmet_before) REPLACE (spare - greatest(0, least(spare, moved - spare_before)) AS spare,
    greatest(0, unmet - greatest(0, moved - unmet_before)) AS unmet), greatest(0, least(spare, moved - spare_before)) AS {given} FROM {name}_m)"""


_PLAN = (
    f"{_WANTS}, t AS (SELECT *, least(wanted, available) AS taken, available - least(wanted, available) AS spare, wanted - least(wanted, available) AS unmet FROM q), "
    + _passed("t", "sib", "target_set, entity_density_bucket", "from_siblings") + ", " + _passed("sib", "cou", "target_set", "from_cousins")
    + """, z0 AS (SELECT *, taken + from_siblings + from_cousins AS quota0 FROM cou), z1 AS (SELECT *, greatest(0, quota0 - coalesce(min_rows, 0)) AS room, greatest(0, sum(quota0) OVER (PARTITION BY target_set) - s) AS over_ FROM z0),
z2 AS (SELECT *, greatest(0, least(room, over_ - coalesce(sum(room) OVER (PARTITION BY target_set ORDER BY room DESC, entity_density_bucket, n_email_spans ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS taken_back FROM z1),
z3 AS (SELECT *, quota0 - taken_back AS quota FROM z2), plan AS (SELECT *, greatest(0, sum(quota) OVER (PARTITION BY target_set) - s) AS over_sample FROM z3)"""
)

ORACLES: dict[str, str] = {
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p5_report": f"""WITH {_PLAN} SELECT target_set, entity_density_bucket, n_email_spans, s AS sample_rows, wanted, available, taken, CAST(from_siblings AS BIGINT) AS from_siblings, CAST(from_cousins AS BIGINT) AS from_cousins,
      CAST(taken_back AS BIGINT) AS taken_back, CAST(quota AS BIGINT) AS quota, available >= wanted AS met, CAST(over_sample AS BIGINT) AS over_sample FROM plan""",
    "p5_counts": f"WITH {_PLAN} SELECT target_set, entity_density_bucket, n_email_spans, CAST(quota AS BIGINT) AS n_rows, CAST(quota AS BIGINT) AS n_ids FROM plan WHERE quota > 0",
    "p2_found": f"WITH {_KEYED}, m AS (SELECT *, min(id) OVER (PARTITION BY table_name, ks, kt) AS keep_id FROM g) SELECT table_name, keep_id, id AS copy_id FROM m WHERE id <> keep_id",
    "p2_copies": f"WITH {_KEYED} SELECT table_name, min(id) AS keep_id, count(DISTINCT id) AS copies FROM g GROUP BY table_name, ks, kt",
    "p5_found": f"WITH {_WANTS} SELECT target_set, entity_density_bucket, n_email_spans FROM q WHERE available < wanted",
}
