"""op11, op12 and op13: thin queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.llm import hard_negatives, pivot_search, whitening
from barflow.llm.common import load, query


@query
def op11_exact_top_k(spark, sf_dir):
    return pivot_search.top_k(load(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


#: rows that take part, with integer components
_ROWS = """
SELECT vec_id, {label} list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
WHERE {where} embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""

OP11_SQL = f"""
WITH v AS ({_ROWS.format(label="", scale=1024, where="")}),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(load(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), moved, F.col("vec_id") % 50 == 0)


OP13_SQL = f"""
WITH v AS ({_ROWS.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,", scale=256, where="label IS NOT NULL AND")}),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE alike) WHERE k <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

QUERIES = {"op11_exact_top_k": op11_exact_top_k, "op12_whitening": op12_whitening, "op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op11_exact_top_k": OP11_SQL, "op13_hard_negatives": OP13_SQL}
